"""A declarative pipeline of event tables: raw, canonical, rejected, a buffer for runs, quality and active queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.canonical import normalise
from trendloom.operators.metrics import event_quality


def expectation() -> F.Column:
    """What a canonical event must meet; rows that don't are rejected, not dropped unseen."""
    return F.coalesce(F.col("event_id").isNotNull() & (F.length("partition_key") > 0) & (F.length("event_type") > 0) & (F.col("event_time_ms") > 0), F.lit(False))


def canonical(raw: DataFrame, source: str) -> DataFrame:
    return normalise(raw, source).where(expectation())


def rejected(raw: DataFrame, source: str) -> DataFrame:
    return normalise(raw, source).where(~expectation())


def define(spark: SparkSession, raw_table: str, registry_table: str, source: str = "raw") -> None:
    """Declare the pipeline's tables; call it in a file that Spark's pipelines run."""
    from pyspark import pipelines as dp

    @dp.table(name="canonical_events", comment="Canonical events that meet the expectation")
    def _canonical() -> DataFrame:
        return canonical(spark.readStream.table(raw_table), source)

    @dp.table(name="rejected_events", comment="Events that don't")
    def _rejected() -> DataFrame:
        return rejected(spark.readStream.table(raw_table), source)

    dp.create_streaming_table(name="event_buffer", comment="Events for runs")

    @dp.append_flow(target="event_buffer", name="append_to_buffer")
    def _append() -> DataFrame:
        return spark.readStream.table("canonical_events")

    @dp.materialized_view(name="event_quality", comment="Counts and times per event type")
    def _quality() -> DataFrame:
        return event_quality(spark.read.table("canonical_events"))

    @dp.materialized_view(name="active_queries", comment="Enabled queries of the registry")
    def _active() -> DataFrame:
        return spark.read.table(registry_table).where("enabled")
