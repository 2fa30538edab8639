"""Toxicity by a classifier chain over hashed word and word-prefix features.

Categories are predicted in order; each linear model sees the probabilities of the categories before it. The
chain is trained with out-of-fold predictions, so a later model meets earlier probabilities as unsure as those it
will get on new documents. Categories are label columns, `quality` and then `toxic`, which decides. Weak categories
may come before them: a document labelled toxic that holds one of a category's seed words.

Features: presence of words and of their first 3 to 6 bytes (lower-cased ASCII), hashed into 2^18 slots. Of these
at most `FEATURES` slots are kept, those with the highest significant chi-square against the last label and `EARLIER_FEATURES` for each
label before it, so the model is bounded. The chain is fitted on at most `sample` labelled documents, those with the least hash of their id; this bound also
makes the ids small enough to broadcast, so fitting moves no texts. Every document is scored.

Defined cases: null or empty text has no features and is never rejected (its last probability is 0, the earlier ones follow the
intercepts); a null in one label leaves the row out of that category alone, rows without the last label are ignored, as are labels of
unknown documents; a label of one class makes its link constant; without both classes in the last label or any telling feature nothing
is rejected; repeated rows are scored one by one, repeated labels of a document count as the larger; a null id is scored like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.stage import stage
from procura.llm.words import ALNUM, Buffer, buffer_of, slices, windows

SLOT_BITS, FEATURES, PREFIXES, FOLDS = 18, 4096, (3, 4, 5, 6), 3
#: Of the features, so many for each label column before the last; its words are common ones, and each costs time in every document.
EARLIER_FEATURES = 128
#: Chi-square with one degree of freedom that a feature must exceed: about one chance in two thousand.
SIGNIFICANT = 12.0
#: Label columns, in the order of the chain.
CATEGORIES = ("quality", "toxic")


def document_slots(buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs of all rows, ordered by row."""
    found = []
    for words in windows(buffer, ALNUM):
        rows = np.searchsorted(buffer.offsets, words.starts, side="right") - 1
        lengths = words.ends - words.starts
        for size in (0, *PREFIXES):
            hashes = words.prefix_hashes(size) if size else words.hashes()
            hashes = hashes ^ np.uint64(size)
            slots = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
            wanted = lengths > size if size else lengths > 0
            found.append(np.unique((rows[wanted] << SLOT_BITS) | slots[wanted].astype(np.int64)))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1)


def _slot_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows, slots = document_slots(buffer_of(part.column("text")))
            offsets = np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(slots.astype(np.int32)))
            yield pa.record_batch([part.column(n) for n in part.schema.names if n != "text"] + [lists], [n for n in part.schema.names if n != "text"] + ["slots"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse 0/1 rows over FEATURES columns, with dense extra columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, extra: np.ndarray):
        self.row, self.column, self.extra, self.count = row, column, extra, len(extra)

    def take(self, chosen: np.ndarray) -> Rows:
        new = np.full(self.count, -1)
        new[chosen] = np.arange(len(chosen))
        keep = new[self.row] >= 0
        return Rows(new[self.row[keep]], self.column[keep], self.extra[chosen])

    def score(self, weights: np.ndarray) -> np.ndarray:
        k = self.extra.shape[1]
        sparse = np.bincount(self.row, weights[self.column], minlength=self.count)
        return sparse + self.extra @ weights[FEATURES : FEATURES + k] + weights[-1]


def fit_linear(rows: Rows, label: np.ndarray, decay: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression by accelerated gradient descent with per-feature step sizes, L2 and a fixed number of steps."""
    k = rows.extra.shape[1]
    weights = np.zeros(FEATURES + k + 1)
    if not 0 < label.sum() < len(label):
        weights[-1] = -20.0 if label.sum() == 0 else 20.0
        return weights
    counts = np.bincount(rows.column, minlength=FEATURES)
    scale = np.concatenate([1.0 / np.sqrt(np.maximum(counts, 1) / rows.count), np.ones(k + 1)])
    scale = np.minimum(scale, 8.0)
    share = label.mean()
    importance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        error = (sigmoid(rows.score(weights)) - label) * importance / rows.count
        gradient = np.concatenate([np.bincount(rows.column, error[rows.row], minlength=FEATURES), rows.extra.T @ error, [error.sum()]]) + decay * weights
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights = weights - 0.2 * (1 - (t - 1) / steps) * scale / 8 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


def fit_chain(row: np.ndarray, column: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Weights per category, and the threshold for the last one. Earlier probabilities enter later models out of fold
    (fold = position mod FOLDS); the threshold is the one with the best F1 out of fold. A row whose label of a category is
    nan teaches that category nothing, but gets its probability."""
    count, chain, extra = len(labels), [], np.zeros((len(labels), 0))
    folds = np.arange(count) % FOLDS
    for c in range(labels.shape[1]):
        rows, known = Rows(row, column, extra), ~np.isnan(labels[:, c])
        held_out = np.zeros(count)
        for fold in range(FOLDS):
            inside, outside = np.flatnonzero((folds != fold) & known), np.flatnonzero(folds == fold)
            held_out[outside] = sigmoid(rows.take(outside).score(fit_linear(rows.take(inside), labels[inside, c])))
        inside = np.flatnonzero(known)
        chain.append(fit_linear(rows.take(inside), labels[inside, c]))
        extra = np.column_stack([extra, held_out])
    return chain, best_threshold(held_out, labels[:, -1])


def best_threshold(probability: np.ndarray, label: np.ndarray) -> float:
    """Between 0.3 and 0.9, where 2 * hits / (positives + reported) is largest."""
    order = np.argsort(-probability, kind="stable")
    hits, reported = np.cumsum(label[order]), np.arange(1, len(label) + 1)
    quality = 2 * hits / (label.sum() + reported)
    best = int(np.argmax(quality))
    following = probability[order[best + 1]] if best + 1 < len(order) else 0.0
    return float(np.clip((probability[order[best]] + following) / 2, 0.3, 0.9))


def apply_chain(chain: list[np.ndarray], row: np.ndarray, column: np.ndarray, count: int) -> np.ndarray:
    extra = np.zeros((count, 0))
    for weights in chain:
        extra = np.column_stack([extra, sigmoid(Rows(row, column, extra).score(weights))])
    return extra


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, categories: Sequence[str] = CATEGORIES, seeds: Mapping[str, Sequence[str]] | None = None
) -> tuple[np.ndarray, list[np.ndarray], float] | None:
    """(column of each slot, -1 for unused slots; the chain's weights; its threshold), or None if the last label holds one class only or no feature tells its classes apart."""
    seeds, last = dict(seeds or {}), categories[-1]
    truth = [f"y_{c}" for c in categories]
    marked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(last).isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(*[F.max(F.col(c).cast("int")).alias(f"y_{c}") for c in categories])
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+")
    # a seeded row counts for its weak category only if the last label holds
    weak = [(F.arrays_overlap(words, F.lit(list(seeds[c]))).cast("int") * F.col(f"y_{last}")).alias(f"y_{c}") for c in seeds]
    fields = [f"y_{c}" for c in seeds] + truth
    known = docs.join(F.broadcast(marked), docs["doc_id"] == marked["id"]).select("doc_id", *weak, *truth, "text")
    known = stage(known.mapInArrow(_slot_lists, ", ".join(["doc_id long", *(f"{x} int" for x in fields), "slots array<int>"])), "labelled")
    chosen: set[int] = set()
    for column in reversed(truth):
        limit = FEATURES - EARLIER_FEATURES * (len(truth) - 1) if column == truth[-1] else EARLIER_FEATURES
        telling = _telling_slots(known.filter(F.col(column).isNotNull()), column, limit)
        if column == truth[-1] and not telling:
            return None
        chosen.update(telling)
    slots_used = np.array(sorted(chosen), dtype=np.int64)
    columns = np.full(1 << SLOT_BITS, -1, dtype=np.int16)
    columns[slots_used] = np.arange(len(slots_used))
    used = F.array_intersect("slots", F.lit([int(x) for x in slots_used]).cast("array<int>"))
    rows = known.select(*fields, used.alias("slots")).orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(sample).toArrow()
    answers = np.column_stack([rows.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in fields])
    slots = rows.column("slots").combine_chunks()
    sizes = slots.value_lengths().to_numpy()
    return columns, *fit_chain(np.repeat(np.arange(len(rows)), sizes), columns[slots.flatten().to_numpy()].astype(np.int64), answers)


def _telling_slots(known: DataFrame, label: str, limit: int) -> list[int]:
    """The slots with the highest significant chi-square against a 0/1 column."""
    n, positive = known.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not positive or positive == n:
        return []
    counted = known.select(label, F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k"))
    a, b = F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double")
    c, d = positive - a, (n - positive) - b
    chi = n * F.pow(a * d - b * c, 2) / ((a + b) * (c + d) * positive * (n - positive))
    best = counted.filter(F.col("n") < n).select("slot", chi.alias("chi")).filter(F.col("chi") > SIGNIFICANT).orderBy(F.desc("chi"), "slot").limit(limit)
    return [r.slot for r in best.collect()]


def scorer(columns: np.ndarray, chain: list[np.ndarray], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """names: of the probabilities, one per link of the chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, slot = document_slots(buffer_of(part.column("text")))
                column = columns[slot].astype(np.int64)
                known = column >= 0
                scores = apply_chain(chain, row[known], column[known], len(part))
                scores[np.bincount(row, minlength=len(part)) == 0, -1] = 0.0
                yield pa.record_batch([*part.columns, *(pa.array(p) for p in scores.T)], [*part.schema.names, *names])

    return run


def score(
    docs: DataFrame, labels: DataFrame, threshold: float | None = None, sample: int = 20_000,
    categories: Sequence[str] = CATEGORIES, seeds: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """threshold: None takes the one found in training. categories: 0/1 columns of `labels`, the last of which decides.
    seeds: words of weak categories, which come before the others.

    Columns of `docs` (doc_id, text and any others but the new ones) with a probability p_<category> for each link, and toxic."""
    names = [f"p_{c}" for c in [*(seeds or {}), *categories]]
    own = [c for c in docs.columns if c not in {*names, "toxic"}]
    docs = docs.select(*own)
    model = train(docs.select("doc_id", "text"), labels, sample, categories, seeds)
    if model is None:
        return docs.select("*", *[F.lit(0.0).alias(x) for x in names], F.lit(False).alias("toxic"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{x}` double" for x in names])
    columns, chain, found = model
    limit = found if threshold is None else threshold
    return docs.mapInArrow(scorer(columns, chain, names), schema).withColumn("toxic", F.col(names[-1]) >= limit)
