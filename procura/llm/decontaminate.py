"""Benchmark decontamination by canonical templates.

Method. Words are lower-cased; numbers, units and names become typed placeholders (a name is a capitalised word, not all
in capitals, that does not begin a sentence). A second form leaves names as they are, since text all in capitals shows none;
a third one is verbatim; in a fourth one every capitalised word is a name, also one that begins a sentence. Windows of
`WINDOW_WORDS` canonical words, unless verbatim with at least `LITERAL` plain words, are
hash-joined with the windows of the benchmark items. A hit counts if its slots are consistent: over all hits of a
document with an item on one alignment, equal values in the item stand against equal values in the document, and
different against different. Items re-asked with other numbers, names or units are found too and marked.
A document is contaminated by an item if consistent hits cover at least `share` of the item's windows.

A bitmap of fixed size over the benchmark's window hashes thins the documents' windows before the join; its false
hits fall out in the join, so its size limits nothing but speed. No text is shuffled.

A window that many items share, such as a common stem, would join every document that has it with every such item. So documents
first meet items in the items' rarest windows alone, so many of them that a document without any of them cannot reach `share`;
only pairs that meet there are joined in full. This is exact, and a stem costs nothing unless it is `share` of an item by itself.

Defined cases: null or empty texts have no windows; an item with fewer words than a window is matched by one window of
its whole length, or by nothing if it has fewer than `least_words` words, which are too unspecific; repeated rows of a
document or an item count once; null ids are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procura.llm.stage import stage
from procura.llm.words import ALNUM, LOWER, Buffer, buffer_of, mix, rolling, slices, windows

WINDOW_WORDS, LITERAL, BITMAP_BITS = 10, 5, 22
#: Units that become a placeholder.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg lb lbs pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit mph kmh watt watts volt volts"
)
_MARKS = {kind: np.uint64(0xC0FFEE00 + k) for k, kind in enumerate(("number", "unit", "name"), 1)}
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63, 10, 58]] = True


def _unit_hashes() -> np.ndarray:
    buffer = buffer_of(pa.array([UNITS]))
    return np.unique(np.concatenate([w.hashes() for w in windows(buffer, ALNUM)]))


def canonical(buffer: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark of the kind, own hash, kind: 0 plain, 1 name, 2 number or unit, 3 capitalised at the begin of a sentence; row start of
    words) of all words."""
    data, offsets = buffer
    folded = data
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if len(accented):
        folded = data.copy()
        folded[accented] += 0x20  # capitals of Latin-1
    inner = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        digit = _DIGIT[data]
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        borders = offsets[(offsets > 0) & (offsets < len(data))]
        inner[borders] = False
        inner[borders - 1] = False
    units, hashes, values, kinds, begins, before = _unit_hashes(), [], [], [], [], 0
    for words in windows(Buffer(folded, offsets), ALNUM, LOWER, inner):
        own = words.hashes()
        first = data[words.starts]
        number = _DIGIT[first]
        unit = np.isin(own, units)
        second = data[np.minimum(words.starts + 1, len(data) - 1)]
        third, fourth = (data[np.minimum(words.starts + k, len(data) - 1)] for k in (2, 3))
        capital = (_UPPER[first] & (_LOWER[second] | ((second == 0xC3) & (third >= 0xA0)))) | (
            (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (_LOWER[third] | ((third == 0xC3) & (fourth >= 0xA0)))
        )
        stops = np.concatenate([[0], np.cumsum(_STOP[data[words.first : words.first + len(words.sums) - 1]])])
        previous = np.concatenate([[before], words.ends[:-1]]) if len(words.ends) else words.ends
        inside = stops[words.starts - words.first] == stops[np.maximum(previous - words.first, 0)]
        follows = (previous > 0) & (np.searchsorted(offsets, previous, side="left") == np.searchsorted(offsets, words.starts, side="right"))
        name = capital & inside & follows & ~number & ~unit & (previous >= words.first)
        mark = np.where(number, _MARKS["number"], np.where(unit, _MARKS["unit"], _MARKS["name"]))
        hashes.append(mark)
        values.append(own)
        kinds.append(np.where(number | unit, 2, np.where(name, 1, np.where(capital, 3, 0))))
        begins.append(words.starts)
        before = int(words.ends[-1]) if len(words.ends) else before
    if not hashes:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(values), np.concatenate(kinds), np.searchsorted(np.concatenate(begins), offsets)


def _bitmap_place(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _windows(lengths: list[int], bitmap: np.ndarray | None, whole_short: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, n_windows, size, form, place, hash, slots) of the windows of each text; only those in the bitmap if one is
    given. whole_short: texts shorter than a window have one window of their own length, and no text has others."""
    bits = np.unpackbits(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                marks, own, kinds, starts = canonical(buffer_of(part.column("text")))
                words = np.diff(starts)
                row_of = np.repeat(np.arange(len(part)), words)
                for form, typed in enumerate(((kinds == 1) | (kinds == 2), kinds == 2, np.zeros(len(kinds), dtype=bool), kinds > 0)):
                    tokens = np.where(typed, marks, own)
                    values = np.where(typed, own | np.uint64(1), np.uint64(0))
                    plain = np.concatenate([[0], np.cumsum(~typed)])
                    for size in lengths:
                        rolled = rolling(tokens, size) ^ np.uint64(4 * size + form)
                        at = np.arange(len(rolled))
                        good = (row_of[: len(at)] == row_of[at + size - 1]) & (plain[size:] - plain[: len(at)] >= min(LITERAL, size))
                        if whole_short and size < WINDOW_WORDS:
                            good &= words[row_of[: len(at)]] == size
                        if bits is not None:
                            good &= bits[_bitmap_place(rolled)] == 1
                        at = np.flatnonzero(good)
                        if not len(at):
                            continue
                        rows = row_of[at]
                        slots = values[at[:, None] + np.arange(size)].view(np.int64)
                        total = np.bincount(rows, minlength=len(part))[rows] if bits is None else np.zeros(len(at), dtype=np.int64)
                        yield pa.record_batch(
                            [
                                part.column("id").take(pa.array(rows)), pa.array(total), pa.array(np.full(len(at), size)), pa.array(np.full(len(at), form)),
                                pa.array(at - starts[rows]), pa.array(rolled[at].view(np.int64)),
                                pa.FixedSizeListArray.from_arrays(pa.array(slots.ravel()), size).cast(pa.list_(pa.int64())),
                            ],
                            ["id", "n_windows", "size", "form", "place", "hash", "slots"],
                        )

    return run


_FIELDS = "id long, n_windows long, size long, form long, place long, hash long, slots array<long>"


def contaminations(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least_words: int = LITERAL) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hits, share, reworded) per document and benchmark item that it contains.

    n_windows: windows of the item; n_hits: those found in the document with consistent slots; reworded: whether a
    slot's value differs. docs: doc_id, text. benchmark: item_id, text. least_words: words of the shortest item that counts.
    """
    texts = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    items = stage(texts.mapInArrow(_windows(list(range(min(least_words, WINDOW_WORDS), WINDOW_WORDS + 1)), None, True), _FIELDS).distinct(), "benchmark")
    lengths = sorted(r[0] for r in items.select("size").distinct().collect())
    bitmap = _bitmap(items)
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hits = stage(source.mapInArrow(_windows(lengths, bitmap, False), _FIELDS), "windows")
    item = items.select(
        F.col("id").alias("item_id"), "n_windows", "hash", "size", "form", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")
    )
    window = ["hash", "size", "form"]
    # written first, so that the join with a popular item may be split
    likely = stage(hits.select("id", *window).join(_rare(items, share), window).select("id", "item_id", "form", "n_windows").distinct(), "likely")
    wanted = likely.join(item, ["item_id", "form", "n_windows"])
    pairs = hits.drop("n_windows").join(wanted, ["id", *window]).select(
        F.col("id").alias("doc_id"), "item_id", "form", "n_windows", "item_place", (F.col("place") - F.col("item_place")).alias("shift"),
        F.filter(F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y")), lambda s: s["x"] != 0).alias("slots"),
    )
    pairs = stage(pairs, "pairs")
    # one row per hit without slots, one per slot otherwise; consistency is a one-to-one map of values per alignment
    alignment = ["doc_id", "item_id", "form", "n_windows", "shift"]
    flat = pairs.select(*alignment, "item_place", F.explode_outer("slots").alias("s"))
    forward = flat.groupBy(*alignment, "s.x").agg(F.countDistinct("s.y").alias("n"), F.bool_or(F.col("s.x") != F.col("s.y")).alias("other"))
    backward = flat.groupBy(*alignment, "s.y").agg(F.countDistinct("s.x").alias("n"))
    broken = (
        forward.filter("n > 1").select(*alignment).union(backward.filter("n > 1").select(*alignment)).distinct()
    )
    changed = forward.groupBy(*alignment).agg(F.coalesce(F.bool_or("other"), F.lit(False)).alias("reworded"))
    good = pairs.select(*alignment, "item_place").join(broken, alignment, "left_anti").join(changed, alignment)
    found = good.groupBy("doc_id", "item_id", "form", "n_windows").agg(F.countDistinct("item_place").alias("n_hits"), F.min("reworded").alias("reworded"))
    part = (F.col("n_hits") / F.col("n_windows")).alias("share")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(part, -F.col("form"), "n_windows", "n_hits", "reworded")).alias("b"))
    return best.filter(F.col("b.share") >= share).select("doc_id", "item_id", "b.n_windows", "b.n_hits", "b.share", "b.reworded")


def _rare(items: DataFrame, share: float) -> DataFrame:
    """(hash, size, form, item_id, n_windows): of each item and form the windows that fewest items have, one more than may be
    missing: n - ceil(share * n) + 1 of n."""
    common = items.groupBy("hash", "size", "form").agg(F.countDistinct("id").alias("common"))
    order = Window.partitionBy("id", "form", "n_windows").orderBy("common", "hash", "place")
    ranked = items.join(common, ["hash", "size", "form"]).withColumn("rank", F.row_number().over(order))
    spare = F.col("n_windows") - F.ceil(F.col("n_windows") * share - 1e-9)
    return stage(ranked.filter(F.col("rank") <= spare + 1).select("hash", "size", "form", F.col("id").alias("item_id"), "n_windows").distinct(), "rare")


def _bitmap(items: DataFrame) -> np.ndarray:
    """2^22 bits, set where a benchmark window hash falls: half a megabyte whatever the benchmark's size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for batch in batches:
            flags[_bitmap_place(batch.column(0).to_numpy().view(np.uint64))] = True
        packed = np.packbits(flags).view(">u8").astype(np.int64)
        words = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(words), pa.array(packed[words])], ["word", "bits"])

    rows = items.select("hash").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros((1 << BITMAP_BITS) // 64, dtype=np.int64)
    packed[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return packed.astype(">i8").view(np.uint8)
