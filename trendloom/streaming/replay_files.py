"""Replaying a table of events through a standing query as a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.plans.spec import QuerySpec
from trendloom.session import scratch
from trendloom.streaming.standing import CHANGES, active_set, standing_changes


def stream_in_files(events: DataFrame, spec: QuerySpec, batches: int) -> DataFrame:
    """(trend_id, partition_key, path): the active trends after events came in micro-batches, in order of time.

    Events go to the shared folder in `batches` files by ranges of time; the stream reads one file
    a trigger, and its changes go to a table in the same folder.
    """
    spark = events.sparkSession
    root = scratch(spark, "standing")
    low, high = events.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    if low is None:
        return spark.createDataFrame([], "trend_id string, partition_key string, path string")
    step = (high - low) // batches + 1
    columns = [f for f in events.columns if f != "op"]
    for i in range(batches):
        part = events.where(F.col("event_time_ms").between(low + i * step, low + (i + 1) * step - 1))
        part.select(*columns, F.lit("upsert").alias("op")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    changes = standing_changes(stream, spec, lateness_ms=high - low)
    query = changes.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    active = active_set(spark.read.schema(CHANGES).parquet(f"{root}/out"))
    return active.select("trend_id", "partition_key", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def through_stream(parts: Sequence[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream's transformation appends when the parts of a table arrive one after another, as a table in the shared folder."""
    spark = parts[0].sparkSession
    files = spark.sparkContext.defaultParallelism
    root = scratch(spark, "replayed")
    for p in parts:
        p.repartition(files).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    made = transform(stream)
    query = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")
