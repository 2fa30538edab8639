"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Method. Each distinct shingle hash falls into one of `BANDS * ROWS` bins and each bin keeps its least hash; an
empty bin borrows from a non-empty one chosen by a hash of (bin, attempt), the optimal densification. Bands of
`ROWS` bins give bucket keys. A bucket first yields star edges: from its centre, the member that shares most buckets
with others, to every other member, so a bucket of k documents gives k - 1 candidate pairs. In a bucket that still spans
several components after that, every pair of members of different components is compared, in blocks of `BLOCK` members
joined by Spark; a block pair sends on links, never pairs. Candidates whose signatures lie six standard deviations below
the threshold are left out, all others are confirmed on full shingle sets; no bucket, however large, is capped or skipped.

Defined cases: null or empty text, or text without words, has no shingles and links with nothing; fewer words
than a shingle make one shingle of the whole sequence; documents with equal sets form one class before anything
else; repeated ids count once; a null id is kept with component null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.llm.graph import components
from procura.llm.stage import stage, tasks_for
from procura.llm.words import buffer_of, mix, shingles, slices, word_hashes

BANDS, ROWS, WORDS = 32, 4, 5
#: Members, and shingles, that a block of an open bucket holds about.
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: Signatures rule a pair out only this many standard deviations below the threshold.
DEVIATIONS = 6.0
BINS = BANDS * ROWS


def signatures(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Densified one-permutation signatures (count x BINS) of sets of 64-bit hashes; values[i] belongs to set rows[i].
    Every set needs a value."""
    bins = (values >> np.uint64(57)).astype(np.int64) + rows * BINS
    least = np.full(count * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bins, values)
    full = np.zeros(count * BINS, dtype=bool)
    full[bins] = True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        row, own = np.divmod(empty, BINS)
        probe = mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> np.uint64(57)
        source = row * BINS + probe.astype(np.int64)[own]
        found = full[source]
        least[empty[found]] = least[source[found]]
        empty = empty[~found]
    return least.reshape(count, BINS)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per set and band; the band is part of the key."""
    grid = least.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grid.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, i])
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, starts = word_hashes(buffer_of(part.column("text")))
            sets = list(shingles(hashes, starts, WORDS))
            sizes = np.array([len(x) for x in sets])
            some = np.flatnonzero(sizes)
            low, high = (np.zeros(len(sets), dtype=np.int64) for _ in range(2))
            lists, brief = pa.nulls(len(sets), pa.list_(pa.int64())), pa.nulls(len(sets), pa.binary())
            if len(some):
                values = np.concatenate(sets)
                at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                low[some] = np.add.reduceat(values, at).view(np.int64)
                high[some] = np.add.reduceat(mix(values), at).view(np.int64)
                least = signatures(values, np.repeat(np.arange(len(some)), sizes[some]), len(some))
                keys = band_keys(least)
                short = np.full(len(sets), b"", dtype=object)
                short[some] = [row.tobytes() for row in mix(least).astype(np.uint16)]
                brief = pa.array(short.tolist(), pa.binary())
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(low), pa.array(high), lists, brief], ["doc_id", "n_shingles", "low", "high", "bands", "signature"])


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, starts = word_hashes(buffer_of(part.column("text")))
                keep = []
                for own, other in zip(shingles(hashes, starts, WORDS), part.column("centre_text").to_pylist(), strict=True):
                    if other != last_text or last_set is None:
                        one = pa.array([other], pa.large_string())
                        last_text, last_set = other, next(shingles(*word_hashes(buffer_of(one)), WORDS))
                    common = len(np.intersect1d(own, last_set, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(own) + len(last_set) - common))
                yield pa.record_batch([part.column("a"), part.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document of `docs` (doc_id long, text string).

    threshold: percent of the union that the intersection must reach.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(
        texts.mapInArrow(_signatures, "doc_id long, n_shingles long, low long, high long, bands array<long>, signature binary"), "signatures"
    )
    ids = signed.filter("doc_id is not null")
    classes = stage(
        ids.filter("n_shingles > 0").groupBy("low", "high", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("r")).select("low", "high", F.col("r.doc_id").alias("rep"), "r.bands", "r.signature", "n_shingles"),
        "classes",
    )
    tasks = tasks_for(classes.count())
    found = components(_links(classes, texts, threshold, tasks), tasks).withColumnRenamed("node", "rep")
    reps = classes.join(found, "rep", "left").select("low", "high", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "low", "high")
        .join(reps, ["low", "high"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _links(classes: DataFrame, texts: DataFrame, threshold: int, tasks: int) -> DataFrame:
    """Confirmed links between class representatives that suffice for the components."""
    members = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    crowds = members.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    buckets = stage(members.join(crowds, "key"), "buckets")
    fame = buckets.groupBy("rep").agg(F.sum("crowd").alias("fame"))
    # written first, so that the join with a crowded bucket may be split
    centres = stage(buckets.join(fame, "rep").groupBy("key").agg(F.max(_rank()).alias("c")).select("key", "c.centre", "c.size"), "centres", tasks)
    starred = _compare(_compatible(buckets.join(centres, "key"), threshold).distinct(), classes, texts, threshold, tasks).filter("linked").select("a", "b")
    return starred.union(_rest(buckets, classes, texts, components(starred, tasks), threshold, tasks))


def _rank() -> Column:
    """The member that shares most buckets with others comes first: the base of a group rather than one of its copies."""
    return F.struct("fame", F.xxhash64("rep").alias("h"), F.col("rep").alias("centre"), F.col("n_shingles").alias("size"))


def _compatible(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a: centre, b: member) whose set sizes do not rule a link out."""
    return (
        pairs.filter(F.col("rep") != F.col("centre"))
        .filter(100 * F.least("n_shingles", "size") >= threshold * F.greatest("n_shingles", "size"))
        .select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    )


def _rest(buckets: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame, threshold: int, tasks: int) -> DataFrame:
    """Links (a, b) between components within the buckets that still span several: every such pair is compared, block against block.
    Blocks hold members of the bucket's largest component or others, and two blocks of the largest one never meet."""
    labels = labels.select(F.col("node").alias("rep"), "component")
    known = buckets.filter("crowd > 2").select("key", "rep", "n_shingles").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = stage(known, "known")
    part = F.struct(F.count(F.lit(1)).alias("n"), "component", F.sum("n_shingles").alias("load"))
    sizes = known.groupBy("key", "component").agg(part.alias("p")).groupBy("key").agg(F.max("p").alias("main"), F.sum("p.n").alias("n"), F.sum("p.load").alias("load")).filter("n > main.n")
    blocks = lambda n, load: F.ceil(F.greatest(n / BLOCK, load / BLOCK_SHINGLES)).cast("int")
    first, other = blocks(F.col("main.n"), F.col("main.load")), blocks(F.col("n") - F.col("main.n"), F.col("load") - F.col("main.load"))
    sizes = sizes.select("key", F.col("main.component").alias("largest"), first.alias("first"), (first + other).alias("blocks"))
    place = F.xxhash64("rep")
    block = F.when(F.col("component") == F.col("largest"), F.pmod(place, F.col("first"))).otherwise(F.col("first") + F.pmod(place, F.col("blocks") - F.col("first")))
    inside = stage(known.join(sizes, "key").select("key", "rep", "component", "first", "blocks", block.cast("int").alias("block")), "open", tasks)
    used = inside.select("rep").distinct()
    own = texts.join(used.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    outline = stage(classes.join(used, "rep").select("rep", "n_shingles", "bands", "signature").join(own.withColumnRenamed("doc_id", "rep"), "rep"), "outline", tasks)
    row = F.struct("rep", "component", "n_shingles", "bands", "signature", "text")
    held = stage(inside.join(outline, "rep").groupBy("key", "block", "first", "blocks").agg(F.collect_list(row).alias("x")), "blocks")
    meets = F.explode(F.sequence(F.greatest("block", "first"), F.col("blocks") - 1)).alias("other")
    left = held.select("key", "block", "x", meets)
    right = held.filter("block >= first").select("key", F.col("block").alias("other"), F.col("x").alias("y"))
    met = left.join(right, ["key", "other"]).select("key", (F.col("block") == F.col("other")).alias("same"), "x", "y")
    return stage(met.mapInArrow(_blocks(threshold), "a long, b long").distinct(), "rest", tasks)


class _Members:
    """The members of one block; shingle sets are made when they are first wanted."""

    def __init__(self, rows: pa.StructArray):
        column = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
        self.rep, self.component, self.size = (column[c].to_numpy() for c in ("rep", "component", "n_shingles"))
        self.bands = column["bands"].flatten().to_numpy().reshape(-1, BANDS)
        self.signature = np.frombuffer(b"".join(column["signature"].to_pylist()), dtype=np.uint16).reshape(-1, BINS)
        self._texts, self._sets = column["text"], {}

    def shingles(self, i: int) -> np.ndarray:
        if i not in self._sets:
            self._sets[i] = next(shingles(*word_hashes(buffer_of(self._texts.slice(i, 1))), WORDS))
        return self._sets[i]


def _blocks(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between components of two blocks. A pair is looked at in its first common bucket only, and not if links
    found in the same two blocks have joined its components already."""

    def links(key: int, same: bool, x: _Members, y: _Members) -> Iterator[tuple[int, int]]:
        joined: dict[int, int] = {}

        def find(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for i in range(len(x.rep)):
            small, large = np.minimum(x.size[i], y.size), np.maximum(x.size[i], y.size)
            good = (y.component != x.component[i]) & (100 * small >= threshold * large)
            if same:
                good[: i + 1] = False
            at = np.flatnonzero(good)
            at = at[(x.signature[i] == y.signature[at]).mean(axis=1) >= _least_agreement(small[at], threshold)]
            at = at[x.bands[i][(x.bands[i] == y.bands[at]).argmax(axis=1)] == key]
            for j in at.tolist():
                a, b = find(int(x.component[i])), find(int(y.component[j]))
                if a == b:
                    continue
                own, other = x.shingles(i), y.shingles(j)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= threshold * (len(own) + len(other) - common):
                    joined[max(a, b)] = min(a, b)
                    yield int(x.rep[i]), int(y.rep[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, same, x, y in zip(*(batch.column(c) for c in ("key", "same", "x", "y")), strict=True):
                found += links(key.as_py(), same.as_py(), _Members(x.values), _Members(y.values))
            ends = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def _least_agreement(size: np.ndarray, threshold: int) -> np.ndarray:
    """Share of bins that a link's signatures agree in: the threshold minus DEVIATIONS standard deviations; the deviation
    follows the number of bins that the smaller set fills."""
    t = threshold / 100
    return t - DEVIATIONS * np.sqrt(t * (1 - t) / (BINS * (1 - np.exp(-size / BINS))))


def _compare(pairs: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int, tasks: int) -> DataFrame:
    """(a, b, linked): pairs whose signatures leave a link possible, each confirmed on the full shingle sets."""
    outline = classes.select("rep", "signature", "n_shingles")
    both = pairs.join(outline.toDF("b", "signature_b", "size_b"), "b").join(outline.toDF("a", "signature_a", "size_a"), "a")
    likely = stage(both.mapInArrow(_likely(threshold), "a long, b long"), "candidates", tasks)
    return stage(_with_texts(likely, texts, tasks).mapInArrow(_confirm(threshold), "a long, b long, linked boolean"), "compared", tasks)


def _likely(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose signatures leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BINS) for c in ("signature_a", "signature_b"))
            size = np.minimum(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= _least_agreement(size, threshold)))

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """Texts of both documents of each pair. The corpus is shuffled once, by id, against the ids in use; then only
    texts in use move, to their centre, where a join of plain keys lets adaptive execution split a popular centre."""
    used = pairs.select(F.col("b").alias("doc_id")).union(pairs.select("a")).distinct().coalesce(tasks)
    own = stage(texts.join(used.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts", tasks)
    members = pairs.join(own.select(F.col("doc_id").alias("b"), "text").hint("merge"), "b")
    centres = own.select(F.col("doc_id").alias("a"), F.col("text").alias("centre_text"))
    return members.join(centres.hint("merge"), "a").select("a", "b", "text", "centre_text")
