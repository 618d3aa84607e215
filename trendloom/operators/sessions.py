"""Sessions: activity of a key split where the key was silent for longer than a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def _clock(ms: Column) -> Column:
    """Milliseconds on a session clock whose unit is the microsecond of a timestamp.

    One millisecond is carried as one microsecond: the whole range of a long fits, and
    nothing is rounded.
    """
    return F.timestamp_micros(ms)


def _gap(units: Column) -> Column:
    """A gap of so many units of the session clock."""
    return F.make_interval(secs=units.cast("decimal(20,0)").cast("decimal(26,6)") / F.lit(1_000_000).cast("decimal(10,0)"))


def sessionize(
    df: DataFrame,
    *,
    key: str = "k",
    time_ms: str = "t",
    gap_ms: int = 1_800_000,
    block_ms: int = 2 * HOUR_MS,
) -> DataFrame:
    """Sessions (k, start_ms, end_ms, duration_ms, n_events) of one row per event.

    Method: merging interval state. Every event opens the interval [t, t + gap]; intervals
    of a key that overlap merge, and a merged interval carries first time, last time and
    number of events. Merging is associative, so it runs in two levels: first within
    (key, block of `block_ms`), then over the partial sessions of the key, whose interval is
    [start, end + gap]. A key that holds a third of all rows is thus spread over its blocks,
    and the second level gets at most one partial session per gap and block of it.

    An event exactly `gap_ms` after the one before joins its session; one a millisecond
    later starts a new one. Equal times count as events each. Rows with a null key or time
    are left out; an empty table gives no sessions. Late rows need nothing special here:
    order of arrival does not matter. The streaming form, with a watermark, is
    `trendloom.streaming.sessions`. `gap_ms` must be at least 1: intervals that only touch
    merge, which makes the gap itself inclusive.
    """
    if gap_ms < 1:
        raise ValueError("gap_ms must be at least 1")
    e = df.where(F.col(key).isNotNull() & F.col(time_ms).isNotNull()).select(
        F.col(key).alias("k"), F.col(time_ms).cast("long").alias("t")
    )
    parts = (
        e.groupBy("k", F.expr(f"t div {int(block_ms)}").alias("block"), F.session_window(_clock(F.col("t")), _gap(F.lit(gap_ms))).alias("w"))
        .agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n"))
        .select("k", "s", "e", "n")
    )
    merged = parts.groupBy(
        "k", F.session_window(_clock(F.col("s")), _gap(F.col("e") - F.col("s") + F.lit(gap_ms))).alias("w")
    ).agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.sum("n").alias("n_events"))
    return merged.select("k", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")
