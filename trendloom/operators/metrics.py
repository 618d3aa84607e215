"""Metrics of runs, ratios derived from them, and alerts on them."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

# Names of the metrics that a run reports.
METRICS = ("paths_found", "paths_truncated", "states_truncated", "temporal_rejects", "error_records", "success_records")
# Metrics that every run must report, and their dimensions.
REQUIRED = (
    "batch_duration_ms", "graph_build_duration_ms", "runtime_duration_ms", "events_in", "vertices_built", "edges_built", "trends_emitted", "paths_truncated",
    "state_read_count", "state_write_count", "state_expired_count", "replay_backlog", "dlq_ratio", "native_threads_used", "mmap_workspace_bytes",
)
DIMENSIONS = ("query_id", "query_version", "partition_key", "batch_id", "runtime_mode")
COLUMNS = "stream_id string, batch_id bigint, query_id string, query_version string, partition_key string, metric_name string, metric_value double"


def trend_metrics(trends: DataFrame) -> DataFrame:
    """(query_id, metric_name, metric_value): trends of each query and, as `_all`, of all."""
    counts = trends.rollup("query_id").agg(F.count(F.lit(1)).alias("n"), F.grouping("query_id").alias("g"))
    return counts.select(F.when(F.col("g") == 1, "_all").otherwise(F.coalesce("query_id", F.lit("unknown"))).alias("query_id"), F.lit("trends_emitted").alias("metric_name"), F.col("n").cast("double").alias("metric_value"))


def long_metrics(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per metric of a wide table of them."""
    return df.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(list(keys), list(names), "metric_name", "metric_value")


def batch_metrics(results: DataFrame) -> DataFrame:
    """Sums of a batch's result rows by query and key, with counts of rows that are `ok` and `err`."""
    return results.groupBy("query_id", "query_version", "partition_key").agg(
        *(F.sum(n).alias(n) for n in METRICS[:4]), F.count_if(F.col("status") == "err").alias("error_records"), F.count_if(F.col("status") == "ok").alias("success_records")
    )


def event_quality(events: DataFrame) -> DataFrame:
    """Per event type: events, distinct keys, first and last event time."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("partition_key").alias("partition_count"), F.min("event_time_ms").alias("min_event_time_ms"), F.max("event_time_ms").alias("max_event_time_ms"))


def derived_ratios(batch: DataFrame) -> DataFrame:
    """(metric_name, metric_value): ratio of dead letters, of truncations and rejects to paths, and the busiest key's paths."""
    one = batch.agg(
        (F.sum("error_records") / F.nullif(F.sum("error_records") + F.sum("success_records"), F.lit(0))).alias("dead_letter_ratio"),
        (F.sum("paths_truncated") / F.greatest(F.sum("paths_found"), F.lit(1))).alias("truncation_ratio"),
        (F.sum("temporal_rejects") / F.greatest(F.sum("paths_found"), F.lit(1))).alias("temporal_reject_rate"),
    )
    hot = batch.groupBy("partition_key").agg(F.sum("paths_found").alias("n")).agg(F.max("n").alias("hot_partition_paths"))
    return long_metrics(one, [], one.columns).unionByName(long_metrics(hot, [], hot.columns))


def alerts(metrics: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(alert, severity, metric_name, metric_value) of metrics above the threshold of a rule (alert, metric, threshold, severity)."""
    table = metrics.sparkSession.createDataFrame(list(rules), "alert string, metric_name string, threshold double, severity string")
    return metrics.join(F.broadcast(table), "metric_name").where("metric_value > threshold").select("alert", "severity", "metric_name", "metric_value")


def load_rules(path: str | Path) -> list[tuple[str, str, float, str, int]]:
    """Alert rules (alert, metric, threshold, severity, seconds) of a YAML or JSON file with a list `alerts`.

    Each has name, severity, expr (`metric > threshold`) and for (a number with s, m or h; by default at once).
    """
    text = Path(path).read_text(encoding="utf-8")
    try:
        document = json.loads(text)
    except ValueError:
        import yaml

        document = yaml.safe_load(text)
    rules = []
    for r in document["alerts"]:
        metric, threshold = (x.strip() for x in str(r["expr"]).split(">"))
        n, unit = re.fullmatch(r"(\d+)\s*([smh]?)", str(r.get("for", "0"))).groups()
        rules.append((r["name"], metric, float(threshold), r.get("severity", "page"), int(n) * {"": 1, "s": 1, "m": 60, "h": 3600}[unit]))
    return rules


def sustained_alerts(samples: DataFrame, rules: Sequence[tuple[str, str, float, str, int]]) -> DataFrame:
    """(alert, severity, metric_name, since_ms, until_ms): breaches that last as long as their rule asks.

    `samples` are (metric_name, at_ms, metric_value). A breach is a stretch of consecutive samples
    of a metric above the threshold; it lasts from its first to its last sample, and counts where
    that is `seconds` at least. A null value is no breach and ends one.
    """
    table = samples.sparkSession.createDataFrame(list(rules), "alert string, metric_name string, threshold double, severity string, seconds bigint")
    w = Window.partitionBy("alert").orderBy("at_ms")
    marked = samples.join(F.broadcast(table), "metric_name").withColumn("over", F.coalesce(F.col("metric_value") > F.col("threshold"), F.lit(False)))
    runs = marked.withColumn("nth", F.sum(F.when(F.col("over"), 0).otherwise(1)).over(w)).where("over")
    return (
        runs.groupBy("alert", "severity", "metric_name", "seconds", "nth").agg(F.min("at_ms").alias("since_ms"), F.max("at_ms").alias("until_ms"))
        .where(F.col("until_ms") - F.col("since_ms") >= F.col("seconds") * 1000).select("alert", "severity", "metric_name", "since_ms", "until_ms")
    )


def replay_backlog(windows: DataFrame, trends: DataFrame) -> DataFrame:
    """(metric_name, metric_value) of the windows still to be recomputed: those of a query and key of which no trend was
    written (updated_at, else created_at) since the window was made. Windows that lack any of these are not counted."""
    keys = ["query_id", "query_version", "partition_key"]
    written = trends.groupBy(*keys).agg(F.max(F.coalesce("updated_at", "created_at")).alias("written"))
    usable = windows.dropna(subset=[*keys, "created_at"])
    open_ = usable.join(written, keys, "left").where("written IS NULL OR written < created_at")
    return open_.agg(F.count(F.lit(1)).cast("double").alias("metric_value")).select(F.lit("replay_backlog").alias("metric_name"), "metric_value")


def required_metrics(measured: DataFrame) -> DataFrame:
    """(metric_name, metric_value, measured): every required metric once, with its sum where a run measured it, else null."""
    names = measured.sparkSession.createDataFrame([(n,) for n in REQUIRED], "metric_name string")
    sums = measured.groupBy("metric_name").agg(F.sum("metric_value").alias("metric_value"))
    return names.join(sums, "metric_name", "left").withColumn("measured", F.col("metric_value").isNotNull())


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """`df`, and an observation that holds the aggregates once a plan over `df` has run: no pass of its own."""
    seen = Observation()
    return df.observe(seen, *(m.alias(n) for n, m in metrics.items())), seen


class StreamMetrics(StreamingQueryListener):
    """Metrics of a session's streams as rows of `COLUMNS`: rows in, durations, and what `DataFrame.observe` named."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event: object) -> None: ...

    def onQueryTerminated(self, event: object) -> None: ...

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        values = {"events_in": p.numInputRows, "batch_duration_ms": p.batchDuration}
        values |= {k: v for held in p.observedMetrics.values() for k, v in held.asDict().items() if isinstance(v, int | float)}
        self.rows += [(p.name or str(p.id), p.batchId, "_all", None, None, k, float(v)) for k, v in values.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, COLUMNS)
