"""Micro-batches against a buffer of earlier events, with rejects, metrics and idempotent writes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom.engine import Options, run
from trendloom.functions.canonical import REQUIRED
from trendloom.operators.metrics import long_metrics
from trendloom.operators.replay import latest_by, upsert
from trendloom.plans.spec import Registry
from trendloom.session import settle
from trendloom.store import Buckets, Snapshots

REJECT = "dlq_id string, batch_id bigint, event_id bigint, partition_key string, error string, payload string"
FAILURE = "batch_id bigint, query_id string, query_version string, error string"


@dataclass
class BufferedRun:
    """`foreachBatch` target: each micro-batch joins the buffered events of its keys, and trends are upserted.

    `root` is a folder of tables: buffer and trends in buckets by key, of which a batch reads and
    writes those of its keys only; rejects, failures and metrics. A batch looks back in the buffer
    by the longest window of the registry and `lateness_ms` before the batch's own first event (or
    `lookback_ms`, if given). Of the touched buckets events go once the latest event time there has
    passed them by `retention_ms` (by default the longest window and the lateness; event time, not
    wall clock, so that history can be replayed). Running a batch again changes nothing: events,
    trends and rejects have identities. A query that fails is noted in `failures`, and the others go on.
    """

    root: str
    registry: Registry
    options: Options = field(default_factory=Options)
    lateness_ms: int = 1_800_000
    lookback_ms: int | None = None
    retention_ms: int | None = None
    buckets: int = 64

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Run over a stream; after a stop or a crash the same checkpoint goes on where it was."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def table(self, spark: object, name: str) -> Buckets | Snapshots:
        bucketed = name in ("buffer", "trends")
        return Buckets(spark, f"{self.root}/{name}", "partition_key", self.buckets) if bucketed else Snapshots(spark, f"{self.root}/{name}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = lambda name: self.table(spark, name)
        number = F.lit(batch_id).cast("long").alias("batch_id")
        fields = [c for c in batch.columns if c not in REQUIRED]
        bad = F.when(F.col("event_id").isNull() | F.col("partition_key").isNull() | F.col("event_type").isNull() | F.col("event_time_ms").isNull(), "missing field").when(F.col("event_type") == "", "empty event_type")
        marked = settle(batch.withColumn("error", bad), "batch")
        wrong = marked.where("error IS NOT NULL").select(number, F.col("event_id").cast("long"), "partition_key", "error", F.to_json(F.struct(*batch.columns)).alias("payload"))
        wrong = wrong.withColumn("dlq_id", F.sha2(F.concat_ws(":", "error", "payload"), 256))
        table("rejects").upsert(wrong.select([c.split()[0] for c in REJECT.split(", ")]).dropDuplicates(["dlq_id"]), ["dlq_id"])

        new = settle(latest_by(marked.where("error IS NULL").drop("error").select(*REQUIRED, *fields), ["partition_key", "event_id"], ["event_time_ms"]), "new")
        counts = marked.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("success_records"), F.count("error").alias("error_records"), F.count(F.lit(1)).alias("events_in"))
        table("metrics").upsert(long_metrics(counts.withColumn("batch_id", number), ["batch_id"], ["success_records", "error_records", "events_in"]), ["batch_id", "metric_name"])
        first = new.agg(F.min("event_time_ms")).first()[0]
        if first is None:
            return
        longest = max((q.within_ms for q in self.registry.enabled()), default=0)
        kept_for = longest + self.lateness_ms if self.retention_ms is None else self.retention_ms

        def merged(old: DataFrame, rows: DataFrame) -> DataFrame:
            both = upsert(old, rows, ["partition_key", "event_id"])
            newest = both.groupBy("partition_key").agg(F.max("event_time_ms").alias("_newest"))
            return both.join(newest, "partition_key").where(F.col("event_time_ms") >= F.col("_newest") - kept_for).select(*rows.columns)

        table("buffer").change(new, merged)
        back = longest + self.lateness_ms if self.lookback_ms is None else self.lookback_ms
        keys = new.select("partition_key").distinct()
        events = settle(table("buffer").read().where(F.col("event_time_ms") >= first - back).join(keys, "partition_key", "left_semi"), "scope")

        failed = []
        for q in self.registry.enabled():
            try:
                found = settle(run(events, Registry((q,)), self.options).withColumn("batch_id", number), "found")
            except Exception as e:  # noqa: BLE001 - whatever a query's plan or data raises is its own failure
                failed.append((batch_id, q.query_id, q.version, str(e).splitlines()[0][:500]))
                continue
            table("trends").upsert(found, ["trend_id"])
        if failed:
            table("failures").upsert(spark.createDataFrame(failed, FAILURE), ["batch_id", "query_id", "query_version"])
