"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.stage import drop_stage, stage, tasks_for


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long), component being the smallest node reachable.

    Each round is a minimum per node (combined before the shuffle) and a join that adaptive execution may split,
    so a node with very many neighbours stays in no single task. Edges never multiply: a round keeps at most as
    many as it got. tasks: how many tasks the given edges deserve, if that is known. Every round is staged in the shared folder and the one before is deleted.
    """
    current = stage(_oriented(edges), "edges", tasks)
    before = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, tasks = tuple(mark), tasks_for(mark[0], 200_000)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least neighbours are written before the joins: only then may adaptive execution split a node with many neighbours
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", tasks)
        large = stage(_large_star(both, least), "edges", tasks)
        lower = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least", tasks)
        following = stage(_oriented(_small_star(large, lower)), "edges", tasks)
        for table in (current, least, large, lower):
            drop_stage(table)
        current = following
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller one."""
    return (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest neighbour (itself included)."""
    return _oriented(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
