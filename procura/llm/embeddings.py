"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale per vector; the norm of the rounding error is kept with it. The
product of two quantised vectors then differs from their cosine by at most |q_x| e_y + e_x (both e being error norms),
so a tile product in whole numbers sorts all pairs into surely linked, surely not, and possibly linked. Only the last
are computed again from the full vectors in double precision.

Vectors go to the nearest of a bounded sample of pivots and are cut, in order of pivot and distance, into tiles of at most
`TILE` vectors. A tile has a centre and a radius; two tiles are multiplied only if their angle allows a link
(angle <= radius + radius + threshold angle), which is exact. A tile pair sends on, per vector, how many links it found
and the smallest id of its part of the linked graph: never the pairs themselves. Equal vectors are one class
before that. On data without any cluster every tile meets every other, and work grows with the square of the
number of vectors, as for any exact join.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components link with nothing; vectors of
different length do not link; rows that repeat an id are vectors of their own, with a common component; a null id
is returned with no links and component null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.graph import components
from procura.llm.stage import stage

TILE, PIVOTS = 2048, 64


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, norm of the rounding error, rounded up) per row of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - values * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return values, scale, error


def unit_rows(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1)[:, None]


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows with cosine >= threshold."""
    ux, uy = unit_rows(x), unit_rows(y)
    (qx, sx, ex), (qy, sy, ey) = quantise(ux), quantise(uy)
    # whole-number products up to 127 * 127 * dimension are exact in float32 below 2^24
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    cosine = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64)
    cosine *= sx[:, None]
    cosine *= sy[None, :]
    bound = np.outer(np.linalg.norm(qx.astype(np.float64) * sx[:, None], axis=1), ey) + ex[:, None] + 1e-9
    sure = cosine - bound >= threshold
    row, column = np.nonzero((cosine + bound >= threshold) & ~sure)
    for at in range(0, len(row), 1 << 16):
        i, j = row[at : at + (1 << 16)], column[at : at + (1 << 16)]
        exact = np.einsum("ij,ij->i", x[i].astype(np.float64), y[j].astype(np.float64))
        exact /= np.linalg.norm(x[i].astype(np.float64), axis=1) * np.linalg.norm(y[j].astype(np.float64), axis=1)
        sure[i, j] = exact >= threshold
    return sure


def _smallest(row: np.ndarray, column: np.ndarray, row_ids: np.ndarray, column_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the component of each row and column in the bipartite graph of links."""
    of_row, of_column = row_ids.copy(), column_ids.copy()
    while True:
        before = of_row.copy(), of_column.copy()
        np.minimum.at(of_row, row, of_column[column])
        np.minimum.at(of_column, column, of_row[row])
        if np.array_equal(before[0], of_row) and np.array_equal(before[1], of_column):
            return of_row, of_column


def _pivoted(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                raw = flat[starts[rows][:, None] + np.arange(size)].astype(np.float32)
                close = unit_rows(raw) @ pivots[int(size)].T
                best = close.argmax(axis=1)
                yield pa.record_batch(
                    [
                        batch.column("rep").take(pa.array(rows)), batch.column("copies").take(pa.array(rows)), pa.array(np.full(len(rows), size, dtype=np.int32)),
                        pa.array(best.astype(np.int32)), pa.array(close[np.arange(len(rows)), best]), pa.array([r.tobytes() for r in raw], pa.binary()),
                    ],
                    ["rep", "copies", "size", "cell", "nearness", "raw"],
                )

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack rows that arrive in order of (size, cell) into tiles."""
    held: list[tuple[int, int, bytes]] = []
    mark = None

    def flush() -> pa.RecordBatch:
        size, cell = mark
        raw = np.frombuffer(b"".join(h[2] for h in held), dtype=np.float32).reshape(len(held), size)
        unit = unit_rows(raw)
        centre = unit.mean(axis=0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm > 1e-9 else unit[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-6
        ids, copies = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
        return pa.record_batch(
            [pa.array([int(ids.min())]), pa.array([size], pa.int32()), pa.array([cell], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]),
             pa.array([ids.tobytes()], pa.binary()), pa.array([copies.tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary())],
            ["tile", "size", "cell", "centre", "radius", "ids", "copies", "raw"],
        )

    for batch in batches:
        for rep, copies, size, cell, raw in zip(*(batch.column(n).to_pylist() for n in ("rep", "copies", "size", "cell", "raw")), strict=True):
            if held and ((size, cell) != mark or len(held) == TILE):
                yield flush()
                held = []
            mark = (size, cell)
            held.append((rep, copies, raw))
    if held:
        yield flush()


def _multiply(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def side(batch: pa.RecordBatch, i: int, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = batch.column("size")[i].as_py()
        ids, copies, raw = (batch.column(n + end)[i].as_py() for n in ("ids", "copies", "raw"))
        return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(raw, np.float32).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x_ids, x_copies, x = side(batch, i, "_x")
                y_ids, y_copies, y = side(batch, i, "_y")
                same = batch.column("tile_x")[i].as_py() == batch.column("tile_y")[i].as_py()
                step = max(1, (1 << 20) // len(y_ids))
                found = []
                for at in range(0, len(x_ids), step):
                    links = linked(x[at : at + step], y, threshold)
                    row, column = np.nonzero(links)
                    row += at
                    if same:
                        row, column = row[row != column], column[row != column]
                    found.append((row, column))
                row, column = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if not len(row):
                    continue
                of_x, of_y = _smallest(row, column, x_ids, y_ids)
                n_x = np.bincount(row, y_copies[column], minlength=len(x_ids)).astype(np.int64)
                n_y = np.bincount(column, x_copies[row], minlength=len(y_ids)).astype(np.int64)
                sides = [(x_ids, n_x, of_x)] if same else [(x_ids, n_x, of_x), (y_ids, n_y, of_y)]
                for ids, n, least in sides:
                    some = np.flatnonzero(n)
                    yield pa.record_batch([pa.array(ids[some]), pa.array(n[some]), pa.array(least[some])], ["rep", "n", "least"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id long, embedding array<float or double>).

    Stored components are taken as float32, the type of the table; cosines are computed in double precision.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = source.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine, F.lit(False)))
    classes = rows.filter("fine").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "vectors")
    pivots = _sample_pivots(classes)
    placed = classes.mapInArrow(_pivoted(pivots), "rep long, copies long, size int, cell int, nearness double, raw binary")
    ordered = placed.repartitionByRange("size", "cell", F.desc("nearness"), "rep").sortWithinPartitions("size", "cell", F.desc("nearness"), "rep")
    tiles = stage(
        ordered.mapInArrow(_tiles, "tile long, size int, cell int, centre array<double>, radius double, ids binary, copies binary, raw binary"), "tiles"
    )
    products = stage(_tile_pairs(tiles, threshold).mapInArrow(_multiply(threshold), "rep long, n long, least long"), "products")
    counts = products.groupBy("rep").agg(F.sum("n").alias("n"))
    # copies of a class may carry different ids: they link with each other and so share the class's component
    found = components(products.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    per_class = (
        classes.join(counts, "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_component"))
    )
    return (
        rows.withColumn("key", F.when(F.col("fine"), F.col("vector")))
        .join(per_class.withColumnRenamed("vector", "key"), "key", "left")
        .withColumn("component_id", F.coalesce("class_component", "vec_id"))
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _sample_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Up to PIVOTS vectors of each length, those with the least hash of their id."""
    out = {}
    for (size,) in classes.select(F.size("vector")).distinct().collect():
        some = classes.filter(F.size("vector") == size).orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).select("vector").collect()
        out[size] = unit_rows(np.array([r[0] for r in some], dtype=np.float32))
    return out


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Both sides of every pair of tiles that may hold a link. Tiles meet through
    equi-joins on pairs of cells; a third of all vectors in one cell still makes many tiles, each a row."""
    theta = float(np.arccos(threshold)) + 1e-6
    outline = tiles.select("tile", "size", "cell", "centre", "radius")

    def angle(x: str, y: str):
        dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))

    left = outline.toDF("tile_x", "size", "cell_x", "centre_x", "radius_x")
    right = outline.toDF("tile_y", "size", "cell_y", "centre_y", "radius_y")
    cells = outline.select("size", "cell").distinct()  # at most PIVOTS a size
    cell_pairs = cells.withColumnRenamed("cell", "cell_x").join(cells.withColumnRenamed("cell", "cell_y"), "size")
    pairs = (
        left.join(cell_pairs, ["size", "cell_x"])
        .join(right, ["size", "cell_y"])
        .filter("tile_x <= tile_y")
        .filter(angle("centre_x", "centre_y") <= F.col("radius_x") + F.col("radius_y") + theta)
        .select("tile_x", "tile_y")
    )
    pairs = stage(pairs, "tile-pairs")
    full = tiles.select("tile", "size", "ids", "copies", "raw")
    x = full.toDF("tile_x", "size", "ids_x", "copies_x", "raw_x")
    y = full.drop("size").toDF("tile_y", "ids_y", "copies_y", "raw_y")
    return pairs.join(x, "tile_x").join(y, "tile_y")
