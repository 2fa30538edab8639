"""Periodic runs of words, found on a grammar.

The words of a batch of texts become exact ids and one Re-Pair grammar: in rounds, the pairs that are the most frequent
ones around them are replaced by a rule, equal pairs by the same rule, so copies share their derivation; once a round
would replace less than one symbol in fifty, what is left is paired up neighbour by neighbour, equal pairs still by one
rule, until one symbol is left per text. Every stretch of a text that holds more than
one word crosses the border between the two parts of exactly one lowest symbol that contains it. So each rule is looked
at once, on its first occurrence: a run of four periods has two of them, a square, on one side of the border. Squares are
found by prefix hashes for all periods at once, confirmed word by word and extended inside the rule. What is found is
translated to every occurrence of the rule, and overlapping stretches of one period merge to maximal ones.

A run is a stretch of words with smallest period q, of at least max(SHORTEST, REPEATS * q) words, that no neighbouring
word extends. Words are maximal runs of bytes other than [\\x20\\x09-\\x0D], taken as they are. Null and empty texts have
no words and no runs; rows that repeat are answered each by itself; an empty table gives no rows. Memory of a task
follows the longest text or a batch of about four megabytes, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.words import mix, power_table, slices

SHORTEST = 6
REPEATS = 4
#: A round that replaces less than one symbol in so many is the last one by frequency.
RARE = 50
#: Places looked at in one go.
BLOCK = 1 << 20


class Rules(NamedTuple):
    """Occurrences of the rules made in one round: where each begins, words on the left and in all, and its rule, an
    index into `example`, the occurrence that stands for the rule."""

    start: np.ndarray
    left: np.ndarray
    length: np.ndarray
    rule: np.ndarray
    example: np.ndarray


def grammar(ids: np.ndarray, texts: np.ndarray) -> Iterator[Rules]:
    """Rules round by round. ids: words of all texts; texts: number of the text of each word."""
    symbol, start, text = ids.astype(np.int64), np.arange(len(ids)), texts
    length = np.ones(len(ids), dtype=np.int64)
    fresh, frequent = int(ids.max()) + 1 if len(ids) else 0, True
    while True:
        linked = text[1:] == text[:-1]
        if not linked.any():
            return
        pairs = (symbol[:-1] << 32) | symbol[1:]
        if frequent:
            _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            chosen = _most_frequent(pairs, np.where(linked, counts[which], 0))
            frequent = len(chosen) * RARE > len(symbol)
        if not frequent:
            first = np.flatnonzero(np.append([True], ~linked))
            place = np.arange(len(symbol)) - np.repeat(first, np.diff(np.append(first, len(symbol))))
            chosen = np.flatnonzero(linked & (place[:-1] % 2 == 0))
        _, example, rule = np.unique(pairs[chosen], return_index=True, return_inverse=True)
        both = length[chosen] + length[chosen + 1]
        yield Rules(start[chosen], length[chosen], both, rule, example)
        symbol, length = symbol.copy(), length.copy()
        symbol[chosen], length[chosen] = fresh + rule, both
        fresh += len(example)
        stay = np.ones(len(symbol), dtype=bool)
        stay[chosen + 1] = False
        symbol, length, start, text = symbol[stay], length[stay], start[stay], text[stay]


def _most_frequent(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of pairs that occur twice and more often than the pairs they overlap with (ties by hash); of overlapping
    equal pairs every second one."""
    order = mix(pairs.astype(np.uint64))
    before, after = np.zeros(len(pairs), dtype=bool), np.zeros(len(pairs), dtype=bool)
    less = (counts[:-1] < counts[1:]) | ((counts[:-1] == counts[1:]) & (order[:-1] < order[1:]))
    same = (pairs[:-1] == pairs[1:]) & (counts[:-1] > 0) & (counts[1:] > 0)
    before[1:], after[:-1] = ~less & ~same, less & ~same  # a neighbour that comes first
    streak = np.append([True], ~same)
    heads = np.flatnonzero(streak)
    sizes = np.diff(np.append(heads, len(pairs)))
    place = np.arange(len(pairs)) - np.repeat(heads, sizes)
    beaten = np.repeat(np.logical_or.reduceat(before | after, heads), sizes) if len(heads) else before
    return np.flatnonzero((counts > 1) & ~beaten & (place % 2 == 0))


class Finder:
    """Stretches with a period that cross the border of a rule, on the words of one batch."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.powers = power_table(max(len(ids) + 1, 2))
        terms = mix(ids.astype(np.uint64) + np.uint64(1)) * self.powers[: len(ids)]
        self.sums = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64))

    def squares(self, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rule, period, start) of squares that end or begin in the middle and fit a run between begin and end."""
        found = []
        most = (end - begin) // REPEATS
        for side in (0, 1):
            room = np.minimum(most, ((end - middle) if side else (middle - begin)) // 2)
            room[end - begin < SHORTEST] = 0
            upto = np.cumsum(room)
            at = 0
            while at < len(room):
                to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")), at + 1)
                rule = np.repeat(np.arange(at, to), room[at:to])
                period = np.arange(len(rule)) - np.repeat(upto[at:to] - room[at:to] - (upto[at - 1] if at else 0), room[at:to]) + 1
                start = middle[rule] - (0 if side else 2 * period)
                hit = self._equal(start, period)
                found.append((rule[hit], period[hit], start[hit]))
                at = to
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def _equal(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where words [start, start + period) and the next `period` ones have equal hashes."""
        inner = self.sums[start + period]
        return (inner - self.sums[start]) * self.powers[period] == self.sums[start + 2 * period] - inner

    def stretches(self, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, end, period) per rule, long enough for a run, as far as they reach inside the rule."""
        rules, periods, starts = self.squares(begin, middle, end)
        order = np.lexsort((periods, rules))
        found: dict[int, list[tuple[int, int, int]]] = {}
        rules, periods, starts = rules[order], periods[order], starts[order]
        borders = np.append(np.flatnonzero(np.append([True], rules[1:] != rules[:-1])), len(rules)) if len(rules) else []
        for at, to in zip(borders[:-1], borders[1:], strict=True):
            rule = int(rules[at])
            for a, b, q in self._of_rule(periods[at:to], starts[at:to], int(begin[rule]), int(end[rule])):
                if b - a >= max(SHORTEST, REPEATS * q):
                    found.setdefault(rule, []).append((a, b, q))
        return found

    def _of_rule(self, periods: np.ndarray, starts: np.ndarray, begin: int, end: int) -> list[tuple[int, int, int]]:
        """Smallest periods first. A square inside a stretch of a smaller period has a multiple of it as period."""
        found = []
        while len(periods):
            q, start = int(periods[0]), int(starts[0])
            periods, starts = periods[1:], starts[1:]
            if not np.array_equal(self.ids[start : start + q], self.ids[start + q : start + 2 * q]):
                continue
            a, b = self._back(start, q, begin), self._on(start + q, q, end)
            found.append((a, b, q))
            outside = (starts < a) | (starts + 2 * periods > b)
            periods, starts = periods[outside], starts[outside]
        return found

    def _on(self, at: int, q: int, end: int) -> int:
        """End of the stretch in which every word from `at` on equals the one q before."""
        size = 2 * q
        while at < end:
            to = min(at + size, end)
            differ = np.flatnonzero(self.ids[at:to] != self.ids[at - q : to - q])
            if len(differ):
                return at + int(differ[0])
            at, size = to, 2 * size
        return end

    def _back(self, at: int, q: int, begin: int) -> int:
        """Start of the stretch in which every word before `at` equals the one q behind."""
        size = 2 * q
        while at > begin:
            to = max(at - size, begin)
            differ = np.flatnonzero(self.ids[to:at] != self.ids[to + q : at + q])
            if len(differ):
                return to + int(differ[-1]) + 1
            at, size = to, 2 * size
        return begin


def runs(ids: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, in words of the batch, by period, then start."""
    finder, stretches = Finder(ids), []
    for start, left, length, rule, example in grammar(ids, texts):
        begin = start[example]
        found = finder.stretches(begin, begin + left[example], begin + length[example])
        if not found:
            continue
        order = np.argsort(rule, kind="stable")
        bounds = np.searchsorted(rule[order], np.arange(len(example) + 1))
        for number, parts in found.items():
            shifts = start[order[bounds[number] : bounds[number + 1]]] - begin[number]
            for a, b, q in parts:
                stretches.append(np.stack([np.full(len(shifts), q), a + shifts, b + shifts], axis=1))
    merged: list[tuple[int, int, int]] = []
    if stretches:
        table = np.unique(np.concatenate(stretches), axis=0)
        for q, a, b in table.tolist():
            if merged and merged[-1][2] == q and merged[-1][1] - a >= q:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), q)
            else:
                merged.append((a, b, q))
    return merged


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _answer(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Per text the number of words, its runs and the words that are left, of a batch of texts."""
    words = [(t or "").encode().split() for t in column.to_pylist()]  # bytes split at ASCII white space only
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    first = np.append([0], np.cumsum(sizes))
    flat = [w for own in words for w in own]
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy() if flat else np.zeros(0, dtype=np.int32)
    texts = np.repeat(np.arange(len(words)), sizes)
    own: list[list[dict]] = [[] for _ in words]
    drop: dict[int, np.ndarray] = {}
    for a, b, q in runs(ids, texts):
        row = int(texts[a])
        own[row].append({"start": a - int(first[row]), "length": b - a, "period": q})
        marks = drop.setdefault(row, np.zeros(int(sizes[row]), dtype=bool))
        marks[a + q - first[row] : b - first[row]] = True
    for found in own:
        found.sort(key=lambda r: (r["start"], r["period"]))
    left = [b" ".join(w if i not in drop else [x for x, gone in zip(w, drop[i], strict=True) if not gone]) for i, w in enumerate(words)]
    return pa.array(sizes), pa.array(own, _RUNS), pa.array([t.decode() for t in left], pa.string())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.record_batch([part.column("row"), *_answer(part.column("text"))], ["row", "n_words", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """Columns of `docs` but text, with n_words long, runs array<struct<start, length, period>> by start, then period, in
    word numbers from 0, and collapsed string: the words outside of runs and in the first period of each, joined by one
    space. Own columns of these names go."""
    kept = [c for c in docs.columns if c not in ("text", "n_words", "runs", "collapsed")]
    rows = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_run, f"row {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "n_words", "runs", "collapsed")
