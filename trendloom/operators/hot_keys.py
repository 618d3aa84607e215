"""Keys that hold a large part of all rows, and blocks of time to split them by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.session import settle


def key_sizes(rows: DataFrame, *, key: str, time_ms: str) -> DataFrame:
    """(k, n, low, high): rows, first and last time of each key; rows without either count nowhere."""
    t = F.col(time_ms).cast("long")
    return rows.where(F.col(key).isNotNull() & t.isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("low"), F.max(t).alias("high"))


def blocks_of_sizes(sizes: DataFrame, *, least_rows: int = 50_000, at_most: int = 2_000, least_block_ms: int = 3_600_000) -> dict[str, int]:
    """`hot_blocks` of a table of `key_sizes` that is cheap to read twice."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(least_rows, total // at_most)
    return {r["k"]: max(least_block_ms, (r["high"] - r["low"] + 1) * limit // (2 * r["n"])) for r in sizes.where(F.col("n") > limit).collect()}


def hot_blocks(rows: DataFrame, *, key: str, time_ms: str, **limits: int) -> dict[str, int]:
    """Block length in ms of each key with more rows than `least_rows` and than one in `at_most` of all.

    There are fewer than `at_most` such keys whatever the data, so the result may be broadcast.
    A key's block is long enough to hold half the limit on average, and `least_block_ms` at least.
    Reads key and time only, once, with partial aggregation; the sizes are written down.
    """
    return blocks_of_sizes(settle(key_sizes(rows, key=key, time_ms=time_ms), "sizes"), **limits)


def with_block_length(df: DataFrame, blocks: dict[str, int] | None, key: str = "k", name: str = "block_ms") -> DataFrame:
    """`df` with the block length of each row's key, null for one that isn't split: a broadcast join with at most 2,000 rows."""
    if not blocks:
        return df.withColumn(name, F.lit(None).cast("long"))
    lengths = df.sparkSession.createDataFrame(list(blocks.items()), f"_hot string, {name} bigint")
    return df.join(F.broadcast(lengths), df[key] == F.col("_hot"), "left").drop("_hot")


def block_number(time_ms: Column, length: Column) -> Column:
    """The number of a row's block of time, null where the length is."""
    return ((time_ms - F.pmod(time_ms, length)) / length).cast("long")
