"""Sessions, late corrections and exactly-once rows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, *, key: str = "partition_key", time: str = "event_time", gap: str = "30 minutes", lateness: str | None = "24 hours") -> DataFrame:
    """Sessions of a stream: every event opens a gap-length interval and overlapping ones merge per key.

    Late events extend, join or add sessions until the watermark, `lateness` behind the latest
    event time, has passed them. In append mode a session comes out once it is closed. A stream
    that has its watermark already takes `lateness=None`.
    """
    return (
        (events if lateness is None else events.withWatermark(time, lateness))
        .groupBy(F.col(key), F.session_window(time, gap).alias("w"))
        .agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n_events"))
        .select(key, "start", "end", "n_events")
    )


def first_deliveries(events: DataFrame, *, event_id: str = "event_id", time: str = "ingested_at", within: str = "24 hours") -> DataFrame:
    """The first delivered row of each identifier of a stream; copies up to `within` apart are dropped."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([event_id])


def period_counts(events: DataFrame, *, time: str = "event_time", period: str = "1 hour", cutoff: str = "24 hours") -> DataFrame:
    """Counts per period of event time, updated as late events arrive, up to the cut-off."""
    return events.withWatermark(time, cutoff).groupBy(F.window(time, period).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("period_start"), "n_events")
