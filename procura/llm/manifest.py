"""Merkle manifest of a table: a digest per row, trees of fan-out 8 per group, one tree over the groups' roots, and for
every row the proof that leads from it to the root.

Rows are ranked inside their group by cutting the order into ranges, so no task holds a group. A level of a tree is one
aggregate over runs of eight consecutive nodes. Proofs come by pointer jumping: every inner node starts with its parent
and the digests beside it, the segment towards that ancestor; each round joins the table with itself on the ancestor,
which doubles the distance and concatenates the segments, until every node points at the root. A row's own siblings lie
in its run, so rows take their path from the finished pointer of their run and segments travel once per run, not per row.

Nulls, empty and very long values have a digest of their own (see leaf_digest). A null order or group value sorts first
and forms a group like any other. Rows that tie in group, order and digest keep places of their own beside each other;
which of them takes which place is open, and they differ in nothing that is digested. An empty table gives no rows.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.llm.stage import stage, tasks_for

FAN_OUT = 8
#: The tree over the groups' roots; groups are numbered from 0.
TOP = -1
_KEY = ("kt", "kl", "kp")


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of all fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings on the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """group, order and the columns of carry for every row, with leaf, subroot and root (hex digests) and path:
    array<struct<left, right>>, the digests beside the row and its ancestors as hex text, from the row to the root."""
    spark = rows.sparkSession
    kept = [F.col(order).alias("o"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]]
    leaves = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf_digest([F.col(f) for f in fields]).alias("h"), F.struct(*kept).alias("x"))
    placed, groups = _places(stage(leaves, "leaves"))
    largest = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    if not largest[1]:
        empty = rows.limit(0).select(group, order, *carry)
        digests = [F.lit("").alias(c) for c in ("leaf", "subroot", "root")]
        return empty.select("*", *digests, F.lit(None).cast("array<struct<left:string,right:string>>").alias("path"))

    base = stage(_runs(placed.filter("n > 1"), 0), "runs")
    lone = stage(placed.filter("n = 1"), "lone")
    levels = _climb(base, _height(largest[0]))
    roots = lone.select(F.col("t").alias("kt"), F.lit(0).alias("kl"), "h")
    for level in levels:
        roots = roots.union(level.filter("n = 1").select(F.col("t").alias("kt"), F.col("l").alias("kl"), "h"))
    subroots = stage(roots, "subroots")

    top = subroots.select(
        F.lit(TOP).cast("long").alias("t"), F.col("kt").alias("p"), F.lit(largest[1]).alias("n"), "h",
        F.struct("kt", "kl", F.lit(0).cast("long").alias("kp")).alias("x"),
    )
    above: list[DataFrame] = []
    if largest[1] > 1:
        first = stage(_runs(top, 0), "runs")
        above = [first, *_climb(first, _height(largest[1]))[1:]]
    root = (above[-1] if above else subroots).select("h").first()[0]

    pointers = None
    for level in levels[1:] + above:
        found = _segments(level)
        pointers = found if pointers is None else pointers.union(found)
    runs = base.select(F.col("t").alias("kt"), F.col("l").alias("kl"), F.col("p").alias("kp"), "children", F.lit(True).alias("hop")).union(
        lone.select(F.col("t").alias("kt"), F.lit(0).alias("kl"), F.lit(0).cast("long").alias("kp"), F.array(F.struct("p", "h", "x")).alias("children"), F.lit(False).alias("hop"))
    )
    if pointers is None:
        runs = runs.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    else:
        finished = _jump(stage(pointers, "pointers"), _height(largest[0]) + _height(largest[1]))
        runs = runs.join(finished.select(*_KEY, "path"), list(_KEY), "left")
        runs = runs.withColumn("path", F.coalesce("path", F.array().cast("array<struct<left:string,right:string>>")))

    proofs = (
        runs.select("kt", "hop", "path", "children", F.posexplode("children").alias("i", "child"))
        .withColumn("path", F.when(F.col("hop"), F.concat(F.array(_beside()), F.col("path"))).otherwise(F.col("path")))
        .select("kt", F.col("child.x").alias("x"), F.col("child.h").alias("leaf"), "path")
    )
    named = groups.join(subroots.select("kt", F.col("h").alias("subroot")), F.col("t") == F.col("kt")).select("kt", "g", "subroot")
    return (
        proofs.join(named, "kt")
        .select(
            F.col("g").alias(group), F.col("x.o").alias(order),
            *[F.col(f"x.c{i}").alias(c) for i, c in enumerate(carry)], "leaf", "subroot", F.lit(root).alias("root"), "path",
        )
    )


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted over range partitions and written, with part and at: a row's place in its partition, counted from any start."""
    columns = [F.col(c).asc_nulls_first() for c in order]
    cut = df.repartitionByRange(tasks_for(df.count(), 200_000), *columns).sortWithinPartitions(*columns)
    cut = stage(cut.withColumn("at", F.monotonically_increasing_id()), "ranked")
    return cut.withColumn("part", F.shiftright("at", 33))


def _places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as nodes (t group number, p place in the group, n nodes of the group, h, x), and the groups (t, g, n)."""
    cut = _ranked(leaves, ["g", "o", "h"])
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stage(
        cut.groupBy("part", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
        .withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))),
        "pieces",
    )
    names = _ranked(stage(pieces.groupBy("g").agg(F.sum("rows").alias("n")), "groups"), ["g"])
    counts = names.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # one row per range of the groups, thousands at most
    shift = counts.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = stage(names.join(shift, "part").select((F.col("at") - F.col("first") + F.col("before")).alias("t"), "g", "n"), "groups")
    located = pieces.join(groups, pieces["g"].eqNullSafe(groups["g"])).select(pieces["part"].alias("part"), "first", "before", "t", "n", pieces["g"].alias("g"))
    placed = cut.join(located, (cut["part"] == located["part"]) & cut["g"].eqNullSafe(located["g"])).select(
        "t", (F.col("at") - F.col("first") + F.col("before")).alias("p"), "n", "h", "x"
    )
    return placed, groups


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """Parents of the nodes of one level: t, l level, p, n nodes of the parents' level, h, children (eight at most)."""
    runs = nodes.groupBy("t", F.floor(F.col("p") / FAN_OUT).alias("up"), "n").agg(F.sort_array(F.collect_list(F.struct("p", "h", "x"))).alias("children"))
    joined = F.array_join(F.transform("children", lambda c: c["h"]), "")
    parents = F.floor((F.col("n") + FAN_OUT - 1) / FAN_OUT)
    return runs.select("t", F.lit(level + 1).alias("l"), F.col("up").alias("p"), parents.alias("n"), F.sha2(joined, 256).alias("h"), "children")


def _climb(base: DataFrame, height: int) -> list[DataFrame]:
    """The written runs of every level, from the given first one up."""
    levels = [base]
    while len(levels) < height:
        own = F.struct(F.col("t").alias("kt"), F.col("l").alias("kl"), F.col("p").alias("kp"))
        nodes = levels[-1].filter("n > 1").select("t", "p", "n", "h", own.alias("x"))
        levels.append(stage(_runs(nodes, len(levels)), "runs"))
    return levels


def _beside() -> Column:
    """The digests left and right of child number i."""
    text = lambda part: F.array_join(F.transform(part, lambda c: c["h"]), "")
    return F.struct(text(F.slice("children", F.lit(1), F.col("i"))).alias("left"), text(F.slice("children", F.col("i") + 2, F.lit(FAN_OUT))).alias("right"))


def _segments(runs: DataFrame) -> DataFrame:
    """Every inner node with its parent as ancestor and the segment that leads there."""
    return runs.select("t", "l", "p", "children", F.posexplode("children").alias("i", "child")).select(
        *[F.col(f"child.x.{k}").alias(k) for k in _KEY],
        F.col("t").alias("at"), F.col("l").alias("al"), F.col("p").alias("ap"), F.array(_beside()).alias("path"),
    )


def _jump(pointers: DataFrame, longest: int) -> DataFrame:
    """Double the distance of every pointer until all reach the root.

    An ancestor at this distance is so many levels up or in the top tree, which leaves few rows on that side: Spark
    broadcasts them if they are small, else adaptive execution may split the descendants of one ancestor.
    """
    distance = 1
    while distance < longest:
        upper = pointers.filter((F.col("kt") == TOP) | (F.col("kl") > distance))
        upper = upper.select(F.col("kt").alias("at"), F.col("kl").alias("al"), F.col("kp").alias("ap"), F.struct("at", "al", "ap", "path").alias("next"))
        joined = pointers.join(upper, ["at", "al", "ap"], "left")
        further = lambda c: F.coalesce(F.col(f"next.{c}"), F.col(c)).alias(c)
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", "next.path"))
        pointers = stage(joined.select(*_KEY, further("at"), further("al"), further("ap"), path.alias("path")), "pointers")
        distance *= 2
    return pointers
