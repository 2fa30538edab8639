"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two machines read a text. The first splits it into pretokens: where one begins depends on the classes of four characters
before and three after a place at most. The second reads the bytes of a pretoken: a state holds every place where a
token may still be under way, with the token that ends there and the number of tokens up to it relative to the present
place; a transition is annotated with the change of that number. Both follow from one property of BPE: a sequence of
tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, so one token at most can
end at each place. States and transitions are compiled when first met and forgotten beyond a limit.

Texts longer than a chunk are cut anywhere. A chunk's state map leads from every item that a state may hold at its
beginning to the items at its end, with the tokens between. Maps compose associatively, and rounds of groups of
neighbouring chunks scan them down to one per text, so chunks of one text are read by many tasks.

Null and empty texts have no bytes and no tokens. Rows that repeat, and rows with null in any other column, are counted
each by itself; an empty table gives no rows. Strings of special tokens inside a text count as one token, as the library
does by default.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.stage import stage
from procura.llm.words import Buffer, buffer_of, slices

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: No token before: the pretoken begins here.
START = -1
#: Characters before and after a chunk that its task sees: two longest tokens and what the splitting needs.
LEFT, RIGHT = 300, 40
#: How a transition writes that the number of tokens stays; it falls by less than the longest token and rises by one.
NO_CHANGE = 250
#: Neighbouring chunk maps composed at once.
GROUP = 32


class Splitter:
    """Where pretokens begin. Classes of characters are asked of the library, once for each character met."""

    def __init__(self, tokenizer) -> None:
        self._pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        added = tokenizer.get_added_tokens_decoder().values()
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) or any(len(s) > RIGHT - 4 for s in self.special):
            raise ValueError("special tokens that take up their surroundings are not supported")
        self._find = re.compile("|".join(re.escape(s) for s in self.special)) if self.special else None
        self._classes = np.zeros(0x110000, dtype=np.uint8)

    def classes(self, points: np.ndarray) -> np.ndarray:
        found = self._classes[points]
        if not found.all():
            for point in np.unique(points[found == 0]).tolist():
                alone = [len(self._pieces(before + chr(point))) == 1 for before in "a1!"]
                self._classes[point] = LETTER if alone[0] else NUMBER if alone[1] else OTHER if alone[2] else SPACE
            found = self._classes[points]
        return found

    def specials(self, text: str, borders: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Where special strings stand; borders: places that none may span."""
        if self._find is None or not any(s in text for s in self.special):
            return []
        spans, at = [], 0
        while found := self._find.search(text, at):
            start, end = found.span()
            crossed = borders[np.searchsorted(borders, start, side="right") :][:1] if borders is not None else []
            if len(crossed) and crossed[0] < end:
                at = start + 1
            else:
                spans.append((start, end))
                at = end
        return spans

    def begins(self, text: str, points: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """True at each character where a pretoken begins. borders: where texts begin, 0 and the end included."""
        n = len(points)
        edge = np.zeros(n + 1, dtype=bool)
        edge[borders] = edge[n] = True
        specials = self.specials(text, borders)
        for span in specials:
            edge[list(span)] = True
        kind = self.classes(points)
        space = kind == SPACE
        before, after = np.empty_like(space), np.empty_like(space)
        before[:1], before[1:] = False, space[:-1]
        after[-1:], after[:-1] = True, space[1:]
        blank = np.zeros(n, dtype=bool)
        blank[1:] = points[:-1] == 32
        change = np.ones(n, dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        begins = np.where(space, ~before | (~after & ~edge[1:]), np.where(before, ~blank, change)) | edge[:-1]
        self._contractions(points, kind, edge, blank, begins)
        for start, end in specials:
            begins[start + 1 : end] = False
        return begins

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, edge: np.ndarray, blank: np.ndarray, begins: np.ndarray) -> None:
        n = len(points)
        at = np.flatnonzero(points == 39)
        at = at[edge[at] | ((kind[at - 1] != OTHER) & ~blank[at])]
        at = at[~edge[at + 1]]
        first = points[at + 1]
        short = at[np.isin(first, [ord(c) for c in "stmd"])]
        begins[short + 1] = False
        begins[(short + 2)[short + 2 < n]] = True
        at = at[at + 2 < n]
        at = at[~edge[at + 2]]
        first, second = points[at + 1], points[at + 2]
        pairs = [("r", "e"), ("v", "e"), ("l", "l")]
        long = at[np.any([(first == ord(a)) & (second == ord(b)) for a, b in pairs], axis=0)]
        begins[long + 1] = begins[long + 2] = False
        begins[(long + 3)[long + 3 < n]] = True


class Transducer:
    """Reads the bytes of pretokens; see above. limit: states kept in a worker."""

    def __init__(self, path: str, limit: int = 150_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        pre, bpe = model["pre_tokenizer"] or {}, model["model"]
        plain = bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.splitter = Splitter(Tokenizer.from_file(path))
        self.limit = limit
        shown = _shown_bytes()
        special = set(self.splitter.special)
        self._whole = frozenset(s.encode() for s in special)
        self.bytes_of = {i: bytes(shown[c] for c in s) for s, i in bpe["vocab"].items() if s not in special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        #: Of a merged token: its parts and the rank of their merge.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair, merged = (bpe["vocab"][left], bpe["vocab"][right]), bpe["vocab"][left + right]
            if merged in self.parts or pair in self.rank:
                raise ValueError("a token with more than one merge is not supported")
            self.rank[pair] = rank
            self.parts[merged] = (*pair, rank)
        self.longest = max(map(len, self.id_of))
        if 2 * self.longest + 4 > LEFT:
            raise ValueError("tokens too long for the context of a chunk")
        self._fill_trie()
        self._fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _fill_trie(self) -> None:
        self.child, self.token, self.depth, self.goes_on = {}, [START], [0], [False]
        for piece, ident in self.id_of.items():
            node = 0
            for byte in piece:
                following = self.child.get(node << 8 | byte)
                if following is None:
                    following = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(START)
                    self.depth.append(self.depth[node] + 1)
                    self.goes_on.append(False)
                    self.goes_on[node] = True
                node = following
            self.token[node] = ident

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.move: dict[int, int] = {}
        self.intern(((0, START, 0),))

    def intern(self, items: tuple) -> int:
        """State number, shifted for a byte beside it."""
        number = self.number.get(items)
        if number is None:
            number = self.number[items] = len(self.states) << 8
            self.states.append(items)
        return number

    def _encode(self, piece: bytes) -> list[int]:
        parts = [self.id_of[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(pairwise(parts)))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [self.id_of[self.bytes_of[parts[at]] + self.bytes_of[parts[at + 1]]]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether both tokens are the encoding of their bytes; START before: the token of its own."""
        known = self._fits.get((before, token))
        if known is None:
            known = self._encode(self.bytes_of[token]) == [token] if before == START else self.fits(START, token) and self._apart(before, token)
            if len(self._fits) > 4 * self.limit:
                self._fits.clear()
            self._fits[before, token] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border while both tokens are built. Backwards in time: what stands beside the
        border, and the rank at which it was merged on. At equal ranks the left one of two merges comes first."""
        left_ends = right_ends = none = len(self.rank)
        while True:
            rank = self.rank.get((left, right), none)
            if rank < left_ends and rank <= right_ends and rank < none:
                return False
            of_left, of_right = self.parts.get(left), self.parts.get(right)
            if of_left and (not of_right or of_left[2] > of_right[2]):
                left, left_ends = of_left[1], of_left[2]
            elif of_right:
                right, right_ends = of_right[0], of_right[2]
            else:
                return True

    def step(self, state: int, byte: int) -> int:
        """Compile one transition: the following state, and in its low byte the change of the number of tokens."""
        items, ended = [], None
        child, token_at, goes_on = self.child, self.token, self.goes_on
        for node, before, tokens in self.states[state >> 8]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token != START and self.fits(before, token):
                if ended is not None:
                    raise RuntimeError("two tokens end at one place")
                ended = token, tokens + 1
            if goes_on[node]:
                items.append((node, before, tokens))
        if ended:
            token, change = ended
            items = [(0, token, 0), *[(node, before, tokens - change) for node, before, tokens in items]]
        else:
            change = 0
        found = self.move[state | byte] = self.intern(tuple(items)) | (change + NO_CHANGE)
        return found

    def run(self, piece: bytes, state: int = 0) -> tuple[int, int]:
        """State behind the bytes and the change of the number of tokens."""
        move, tokens = self.move, 0
        for byte in piece:
            found = move.get(state | byte)
            if found is None:
                found = self.step(state, byte)
            state = found & -256
            tokens += found & 255
        return state, tokens - NO_CHANGE * len(piece)

    def tokens(self, pretoken: bytes) -> int:
        if pretoken in self._whole:
            return 1
        if len(self.states) > self.limit:
            self._forget()
        return self.run(pretoken)[1]

    def _totals(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken. Lanes that read the same bytes from the start share one run."""
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        lanes = pieces.dictionary_encode()
        distinct = lanes.dictionary.to_pylist()
        counts = np.zeros(len(distinct), dtype=np.int64)
        for i in sorted(range(len(distinct)), key=distinct.__getitem__):  # neighbours pass through the same states
            counts[i] = self.tokens(distinct[i])
        return counts[lanes.indices.to_numpy()]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every whole text."""
        data, offsets = buffer_of(texts)
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        begins, places = self._begins(Buffer(data, offsets))
        starts = places[begins]
        upto = np.concatenate([[0], np.cumsum(self._totals(np.ascontiguousarray(data), starts))])
        return np.diff(upto[np.searchsorted(starts, offsets)])

    def _begins(self, buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffer
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        return self.splitter.begins(text, points, np.searchsorted(places, offsets)), places

    # Chunks of long texts

    def chunk_map(self, left: str, body: str, right: str, first: bool, last: bool) -> list[tuple[int, int, int, int, int]]:
        """(bytes back, token) of an item at the beginning, the same of an item at the end, and the tokens between."""
        raw = [part.encode() for part in (left, body, right)]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        begins, places = self._begins(Buffer(data, np.array([0, len(data)])))
        bounds = places[begins]
        start, stop = len(raw[0]), len(raw[0]) + len(raw[1])
        ends = np.append(bounds[(bounds > start) & (bounds <= stop)], [stop] if last else []).astype(np.int64)
        ends = np.unique(ends)
        whole = data.tobytes()
        fresh = ((0, START), ((0, START, 0),))
        if first or start in bounds:
            ends = np.append([start], ends)
            groups = [((0, START), 0)]
        else:
            entries = self._entries(whole, start, bounds)
            if not len(ends):
                return [(*entry, *leave, n) for entry, leave, n in self._through(entries, whole[start:stop])]
            groups = [(entry, n) for entry, _, n in self._through(entries, whole[start : ends[0]], ended=True)]
        between = 0
        if len(ends) > 1:
            between = int(self._totals(np.ascontiguousarray(data[ends[0] : ends[-1]]), ends[:-1] - ends[0]).sum())
        tail = self._through([fresh], whole[ends[-1] : stop])
        return [(*entry, *leave, n + between + m) for entry, n in groups for _, leave, m in tail]

    def _entries(self, whole: bytes, at: int, bounds: np.ndarray) -> list[tuple[tuple[int, int], tuple]]:
        """Every item that a state may hold at a place inside a pretoken."""
        begin = int(bounds[np.searchsorted(bounds, at) - 1])
        found = []
        for back in range(min(self.longest, at - begin + 1)):
            node = 0
            for byte in whole[at - back : at]:
                node = self.child.get(node << 8 | byte, START)
                if node == START:
                    break
            if node == START or not self.goes_on[node]:
                continue
            place = at - back
            before = [START] if place == begin else [self.id_of.get(whole[place - n : place], START) for n in range(1, min(self.longest, place - begin) + 1)]
            found += [((back, token), ((node, token, 0),)) for token in before if token != START or place == begin]
        return found

    def _through(self, entries: list, piece: bytes, ended: bool = False) -> list[tuple[tuple, tuple, int]]:
        """(entry, item at the end, tokens between) for all that lead on. Entries whose states meet go on together.
        ended: a pretoken ends here, so a token must."""
        groups = {items: [(entry, 0)] for entry, items in []}
        for entry, items in entries:
            groups.setdefault(items, []).append((entry, 0))
        for at in range(0, len(piece), 64):
            following: dict[tuple, list] = {}
            for items, members in groups.items():
                if len(self.states) > self.limit:
                    self._forget()
                state, change = self.run(piece[at : at + 64], self.intern(items))
                if self.states[state >> 8]:
                    following.setdefault(self.states[state >> 8], []).extend((entry, n + change) for entry, n in members)
            groups = following
        found = []
        for items, members in groups.items():
            if ended:
                items = tuple((0, START, n) for node, _, n in items if node == 0)
            found += [(entry, (self.depth[node], token), n + m) for entry, n in members for node, token, m in items]
        return found


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def compose(maps: list[list[dict]]) -> list[dict]:
    """One map of consecutive chunks."""
    total = maps[0]
    for following in maps[1:]:
        onward: dict[tuple[int, int], list] = {}
        for m in following:
            onward.setdefault((m["back"], m["token"]), []).append(m)
        total = [
            {"back": m["back"], "token": m["token"], "to_back": f["to_back"], "to_token": f["to_token"], "n": m["n"] + f["n"]}
            for m in total
            for f in onward.get((m["to_back"], m["to_token"]), ())
        ]
    return total


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


_MAP = "array<struct<back:int,token:int,to_back:int,to_token:int,n:bigint>>"
_MAP_TYPE = pa.list_(pa.struct([("back", pa.int32()), ("token", pa.int32()), ("to_back", pa.int32()), ("to_token", pa.int32()), ("n", pa.int64())]))
Batches = Iterator[pa.RecordBatch]


def _count(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = machine(path).count(part.column("text"))
                yield pa.record_batch([part.column("row"), pa.array(counts)], ["row", "n_tokens"])

    return run


def _cut(path: str, chunk: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        splitter = machine(path).splitter
        names = ["row", "key", "chunk", "left", "body", "right", "last"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for i in range(len(batch)):
                text, key = batch.column("text")[i].as_py(), uuid.uuid4().hex
                cuts = [0]
                spans = splitter.specials(text)
                inside = {p: s for s, e in spans for p in range(s + 1, e)}
                while cuts[-1] + chunk < len(text):
                    cut = cuts[-1] + chunk
                    cuts.append(inside[cut] if inside.get(cut, 0) > cuts[-1] else cut)
                for number, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True)):
                    values = [key, number, text[max(a - LEFT, 0) : a], text[a:b], text[b : b + RIGHT], b == len(text)]
                    yield pa.record_batch([batch.column("row").slice(i, 1), *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], names)

    return run


def _maps(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = []
            for row in batch.select(["chunk", "left", "body", "right", "last"]).to_pylist():
                triples = machine(path).chunk_map(row["left"], row["body"], row["right"], row["chunk"] == 0, row["last"])
                found.append([dict(zip(("back", "token", "to_back", "to_token", "n"), t, strict=True)) for t in triples])
            yield pa.record_batch([batch.column("row"), batch.column("key"), batch.column("chunk"), pa.array(found, _MAP_TYPE)], ["row", "key", "chunk", "map"])

    return run


def _composed(batches: Batches) -> Batches:
    for batch in batches:
        found = [compose([m["map"] for m in maps]) for maps in batch.column("maps").to_pylist()]
        yield pa.record_batch([batch.column("row"), batch.column("key"), batch.column("chunk"), pa.array(found, _MAP_TYPE)], ["row", "key", "chunk", "map"])


def count(docs: DataFrame, path: str, chunk: int = 1 << 16) -> DataFrame:
    """Columns of `docs` but text, with n_bytes (UTF-8) and n_tokens, both long; own columns of these names go.

    path: a tokenizer file that every executor can open. chunk: characters of a text that one task reads at most.
    """
    if chunk <= LEFT:
        raise ValueError(f"a chunk needs more than {LEFT} characters")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.octet_length(text).cast("long").alias("n_bytes")).alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    short = rows.filter(F.length("text") <= chunk).mapInArrow(_count(path), f"row {kind}, n_tokens bigint")
    pieces = rows.filter(F.length("text") > chunk).mapInArrow(
        _cut(path, chunk), f"row {kind}, key string, chunk int, left string, body string, right string, last boolean"
    )
    # small row groups, so the chunks of one long text are read by several tasks
    pieces = stage(pieces, "chunks", **{"parquet.block.size": 4 << 20})
    most = pieces.agg(F.max("chunk")).first()[0]
    counted = short
    if most is not None:
        maps = stage(pieces.mapInArrow(_maps(path), f"row {kind}, key string, chunk int, map {_MAP}"), "maps")
        while most > 0:
            groups = maps.groupBy("key", F.floor(F.col("chunk") / GROUP).cast("int").alias("up")).agg(
                F.first("row").alias("row"), F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("maps")
            )
            maps = groups.select("row", "key", F.col("up").alias("chunk"), "maps").mapInArrow(_composed, f"row {kind}, key string, chunk int, map {_MAP}")
            most //= GROUP
        counted = short.union(maps.select("row", F.col("map")[0]["n"].alias("n_tokens")))
    return counted.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], F.col("row.n_bytes").alias("n_bytes"), "n_tokens")
