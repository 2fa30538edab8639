"""Joins of many rows with one row per key, where one key may hold a large share of the rows.

A sort-merge join whose other side is an aggregate on the join key takes over that aggregate's partitioning, and adaptive
execution then leaves a large partition whole. Here the side per key is written first, so that it may be split. A key
with more rows than a task should get is dealt to pieces before the shuffle, whatever thresholds the session has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.sources.tables import MANY_ROWS, TASK_ROWS, durable

#: Rows of one key that one task takes.
PIECE_ROWS = 1_000_000
#: Keys that are dealt to pieces, at most: no more than this many can hold one part in so many of all rows.
MOST_HOT = 1000


def join_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, count: str, how: str = "inner", stored: bool = False, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """rows joined with per_key, which has one row per value of `key` and says in `count` how many rows that value has;
    `count` is dropped. how: inner or left. stored: per_key already comes from storage.

    Rows with a null key match nothing; a left join keeps them, spread over all tasks.
    """
    per_key = per_key if stored else durable(per_key)
    total, largest = per_key.agg(F.sum(count), F.max(count)).first()
    limit = max(piece_rows, (total or 0) // MOST_HOT)
    if (largest or 0) <= limit:
        # a share of the keys that holds at most TASK_ROWS a task; null keys of a left join are left to the session's thresholds
        even = how == "inner" and (total or 0) > MANY_ROWS and largest <= TASK_ROWS
        return (rows.repartition(-(-total // TASK_ROWS), key) if even else rows).join(per_key.drop(count), key, how)
    # fewer than MOST_HOT keys can exceed the limit
    hot = per_key.filter(F.col(count) > limit).select(key, F.ceil(F.col(count) / limit).cast("int").alias("_pieces"))
    own = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_piece", F.when(F.col(key).isNull(), F.pmod(own, F.lit(MOST_HOT))).otherwise(F.coalesce(F.pmod(own, F.col("_pieces")), F.lit(0))).cast("int")
    )
    pieces = F.greatest(F.ceil(F.col(count) / limit).cast("int"), F.lit(1))
    copies = per_key.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(count)
    return dealt.drop("_pieces").join(copies, [key, "_piece"], how).drop("_piece")
