"""SentencePiece encoding and decoding through a table of distinct chunks.

No multi-character piece of the model has a whitespace marker after another character, and none has a line feed,
so pieces never cross the places where a run of spaces or a line feed begins. The text is cut there. Each distinct
chunk is segmented once by the library and kept in a table; a text's ids are joined back by the positions of its
chunks. The table belongs to a worker and holds a bounded number of chunks, so memory does not grow with the
corpus, and neither texts nor chunks are shuffled.

The property is checked on the given model before anything runs. Defined cases: null text counts as empty, empty
text has no ids; repeated rows are encoded one by one; a text without any cut is a single chunk of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.words import LONG, WINDOW, buffer_of, mix, power_table, slices

MARK = "▁"


def check_model(model) -> None:
    """Raise if a piece could cross a cut, or if the model normalises text."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and (MARK in piece.lstrip(MARK) or "\n" in piece):
            raise ValueError(f"piece {i} crosses a chunk border")
    probe = "a  ﬁ Å Å b c"
    if model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model normalises its input")


class ChunkTable:
    """Ids of distinct chunks by hash, of long ones by a digest. Holds at most LIMIT chunks: a full table is emptied before a batch adds to it."""

    LIMIT = 500_000

    def __init__(self, model):
        check_model(model)
        self.model, self.marker = model, model.piece_to_id(MARK)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.sizes = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def places(self, keys: np.ndarray, sizes: np.ndarray, text: Callable[[int], bytes], first: np.ndarray) -> np.ndarray:
        """Row in the table of each distinct chunk; new chunks are segmented and added. A key found with another
        byte length is a collision and stops the task."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            if len(self.keys) > self.LIMIT:
                self._clear()
                known[:] = False
            new = np.flatnonzero(~known)
            encoded = self._segment([text(i).decode() for i in new.tolist()], first[new])
            counts = np.array([len(x) for x in encoded])
            starts = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            self.keys = all_keys[order]
            self.sizes = np.concatenate([self.sizes, sizes[new]])[order]
            self.starts = np.concatenate([self.starts, starts])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(encoded), np.int32, int(counts.sum()))])
            at = np.searchsorted(self.keys, keys)
        if not np.array_equal(self.sizes[at], sizes):
            raise ValueError("two chunks share a hash")
        return at

    def _segment(self, chunks: list[str], first: np.ndarray) -> list[list[int]]:
        """The library puts a marker in front of what it encodes: right for a text's first chunk, in place of the first
        space of a marked chunk, and to be dropped again before a line feed."""
        plain = [c if f or c[0] == "\n" else c[1:] for c, f in zip(chunks, first, strict=True)]
        encoded = self.model.encode(plain, num_threads=1)
        for i, (chunk, is_first) in enumerate(zip(chunks, first, strict=True)):
            if not is_first:
                if chunk[0] == "\n":
                    encoded[i] = encoded[i][1:]
                elif chunk == " ":
                    encoded[i] = [self.marker]
        return encoded

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Same ids as the library's encode() for every text; null counts as empty."""
        data, offsets = buffer_of(pc.replace_substring(texts.fill_null(""), MARK, " "))
        starts, first = _chunks(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = _chunk_hashes(data, starts, ends) ^ np.where(first, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
        sizes = (ends - starts).astype(np.int32)[example]
        raw, begin, end = data.tobytes(), starts[example].tolist(), ends[example].tolist()
        at = self.places(distinct, sizes, lambda i: raw[begin[i] : end[i]], first[example])[place]
        counts = self.counts[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        picks = np.arange(upto[-1]) + np.repeat(self.starts[at] - upto[:-1], counts)
        rows = upto[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(self.ids[picks]))


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and whether a chunk is the first of its text."""
    begins = np.zeros(len(data) + 1, dtype=bool)
    space = data == 32
    begins[:-1] = data == 10
    begins[0] |= len(data) > 0
    begins[1:-1] |= space[1:] & ~space[:-1]
    begins[offsets] = True
    starts = np.flatnonzero(begins[:-1])
    heads = np.zeros(len(data) + 1, dtype=bool)
    heads[offsets] = True
    return starts, heads[starts]


def _chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, at = [], 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + WINDOW, side="right")), at + 1)
        lengths = ends[at:to] - starts[at:to]
        powers = power_table(int(lengths.max()))
        begin = starts[at]
        place = np.arange(ends[to - 1] - begin) - np.repeat(starts[at:to] - begin, lengths)
        terms = (data[begin : ends[to - 1]].astype(np.uint64) + np.uint64(1)) * powers[place]
        hashes = mix(np.add.reduceat(terms, starts[at:to] - begin))
        for i in np.flatnonzero(lengths > LONG).tolist():
            chunk = data[starts[at + i] : ends[at + i]].tobytes()
            hashes[i] = int.from_bytes(blake2b(chunk, digest_size=8).digest(), "little")
        out.append(hashes)
        at = to
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


_tables: dict[str, ChunkTable] = {}


def _run(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        table = _tables.get(path)
        if table is None:
            table = _tables[path] = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=path))
        for batch in batches:
            for part in slices(batch, "text", WINDOW):
                ids = table.encode(part.column("text"))
                decoded = table.model.decode([x.tolist() for x in ids.to_numpy(zero_copy_only=False)], num_threads=1)
                yield pa.record_batch([*part.columns, ids, pa.array(decoded, pa.string())], [*part.schema.names, "ids", "decoded"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Columns of `docs` (text string and any others but ids and decoded) with ids array<int> and decoded string.

    model_path: a sentencepiece model that every executor can open under this path.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")])
    docs = docs.withColumn("text", F.col("text").cast("string"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_run(model_path), f"{own}, ids array<int>, decoded string")
