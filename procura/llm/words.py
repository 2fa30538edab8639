"""Vectorised word hashing over Arrow string columns.

A text column is read as one byte buffer. Words are maximal runs of word bytes; a word's hash is a
64-bit polynomial over its (mapped) bytes, of long words, where different ones with equal polynomials can be written
down, a keyless BLAKE2b digest. Work goes through windows of about a megabyte that end at
word borders, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
#: Bytes from which on a word is digested.
LONG = 48
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Upper-case ASCII letters to lower case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space as in [\x20\x09-\x0D]; everything else belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: ASCII letters and digits and all bytes of other characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


class Buffer(NamedTuple):
    """Bytes of a text column and the byte offset at which each row starts (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray


def buffer_of(column: pa.Array) -> Buffer:
    """Null rows count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return Buffer(data, offsets - (offsets[0] if len(offsets) else 0))


class Words(NamedTuple):
    """Words of one window. starts/ends are byte positions in the buffer, ends exclusive; sums[i] is the
    running sum of byte terms up to position first + i, so any prefix of a word has a hash at once."""

    first: int
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    data: np.ndarray
    lower: np.ndarray

    def hashes(self) -> np.ndarray:
        found = mix(self._before(self.ends) - self._before(self.starts))
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            word = self.lower[self.data[self.starts[i] : self.ends[i]]].tobytes()
            found[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found

    def prefix_hashes(self, length: int) -> np.ndarray:
        """Hash of the first `length` bytes; for shorter words the same as hashes()."""
        return mix(self._before(np.minimum(self.starts + length, self.ends)) - self._before(self.starts))

    def _before(self, position: np.ndarray) -> np.ndarray:
        return self.sums[position - self.first]


_powers = np.ones(1, dtype=np.uint64)


def power_table(length: int) -> np.ndarray:
    global _powers
    if len(_powers) < length:
        steps = np.full(max(length, 1024), _PRIME, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def windows(buffer: Buffer, is_word: np.ndarray, lower: np.ndarray = LOWER, joins: np.ndarray | None = None) -> Iterator[Words]:
    """All words of the buffer, window by window. joins: extra positions that belong to words."""
    data, offsets = buffer
    borders = np.unique(offsets)
    at, end = 0, len(data)
    while at < end:
        stop = min(at + WINDOW, end)
        if stop < end:
            stop = _cut(data, borders, is_word, joins, at, stop)
        part = data[at:stop]
        inside = is_word[part] if joins is None else is_word[part] | joins[at:stop]
        begins = np.zeros(stop - at + 1, dtype=bool)
        begins[-1] = True
        begins[borders[np.searchsorted(borders, at) : np.searchsorted(borders, stop)] - at] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | begins[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
        sums = np.zeros(stop - at + 1, dtype=np.uint64)
        if len(starts):
            lengths = ends - starts
            powers = power_table(int(lengths.max()))
            places = np.flatnonzero(inside)
            term = (lower[part[places]].astype(np.uint64) + np.uint64(1)) * powers[places - np.repeat(starts, lengths)]
            sums[places + 1] = term
            np.cumsum(sums, out=sums)
        yield Words(at, starts + at, ends + at, sums, data, lower)
        at = stop


def _cut(data: np.ndarray, borders: np.ndarray, is_word: np.ndarray, joins: np.ndarray | None, at: int, stop: int) -> int:
    """The last place up to `stop` where no word is cut, or the first one after it."""
    inside = is_word[data[at:stop]] if joins is None else is_word[data[at:stop]] | joins[at:stop]
    gaps = np.flatnonzero(~inside)
    border = borders[max(np.searchsorted(borders, stop, side="right") - 1, 0)]
    found = max(int(gaps[-1]) + at + 1 if len(gaps) else at, int(border))
    if found > at:
        return found
    following = borders[np.searchsorted(borders, stop, side="right") :]
    limit = int(following[0]) if len(following) else len(data)
    while stop < limit:
        step = min(stop + WINDOW, limit)
        inside = is_word[data[stop:step]] if joins is None else is_word[data[stop:step]] | joins[stop:step]
        gaps = np.flatnonzero(~inside)
        if len(gaps):
            return stop + int(gaps[0]) + 1
        stop = step
    return limit


def word_hashes(buffer: Buffer, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words start (one more at the end)."""
    hashes, starts = [], []
    for words in windows(buffer, is_word):
        hashes.append(words.hashes())
        starts.append(words.starts)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(buffer.offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), buffer.offsets)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values, regardless of rows."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        out *= _PRIME
        out += hashes[i : i + count]
    return mix(out)


def shingles(hashes: np.ndarray, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles. A row with fewer words has its whole
    sequence as one shingle, a row without words none."""
    rolled = rolling(hashes, n)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield rolling(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about `limit` bytes of text, one row at least."""
    text = batch.column(column)
    sizes = text.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < len(batch):
        to = max(int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to
