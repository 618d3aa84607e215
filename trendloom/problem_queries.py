"""Queries p1 to p5 over the whole event buffer and window tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.buffer_events import canonical_events, is_event
from trendloom.operators.delivery import deliver_once
from trendloom.operators.features import feature_entries, feature_table
from trendloom.operators.intervals import periods_and_gaps
from trendloom.operators.lateness import late_corrections
from trendloom.operators.sessions import sessionize
from trendloom.streaming.replay_files import through_stream
from trendloom.streaming.sessions import first_deliveries, period_counts, session_stream
from trendloom.tables import table


def _buffer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cet_event_buffer_v5")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    e = canonical_events(_buffer(spark, d))
    return sessionize(e, gap_ms=1_800_000).select(F.col("k").alias("partition_key"), "start_ms", "end_ms", "n_events")


def p1_session_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by number of events: how many, and their total and longest duration."""
    e = canonical_events(_buffer(spark, d))
    return sessionize(e).groupBy("n_events").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return deliver_once(_buffer(spark, d)).where("n_copies > 1").select("event_id", "batch_id")


def p2_kept_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """How many messages each batch keeps, and how many copies were dropped for them."""
    return deliver_once(_buffer(spark, d)).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum(F.col("n_copies") - 1).alias("n_dropped"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return feature_entries(canonical_events(_buffer(spark, d))).select(F.col("k").alias("partition_key"), "type_key", F.col("n").alias("n_events"), F.col("last").alias("last_event_time_ms"))


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    """The wide table: a row per entity, a count and a latest time column for each type."""
    return feature_table(canonical_events(_buffer(spark, d)))


#: Types whose columns of the wide table its SQL checks beside the totals; a type that no event has is one of them.
FEATURE_TYPES = ("badgefail", "certgrant", "ledgerwrite", "mailboxwrite", "nosuchtype", "quotaread", "vaultopen")


def p3_features_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with the columns of chosen types; other types count nowhere."""
    return feature_table(canonical_events(_buffer(spark, d)), list(FEATURE_TYPES))


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    kept = deliver_once(_buffer(spark, d), carry=F.when(is_event(), F.col("event_time_ms")))
    return late_corrections(kept, time_ms="carry")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _corrections(spark, d).where("corrects").select("period_start_ms", "batch_id")


def p4_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by event time after all corrections, and how many batches gave to each."""
    return _corrections(spark, d).groupBy("period_start_ms").agg(F.sum("n_added").alias("n_events"), F.sum(F.col("corrects").cast("bigint")).alias("n_correcting")).where("n_events > 0")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "cet_impacted_windows_v2")).select(F.col("k").alias("partition_key"), "kind", "start_ms", "end_ms")


def _arrivals(df: DataFrame, time: str) -> list[DataFrame]:
    """A table in three parts that arrive out of order of time, and a last row far behind all others that closes what is open."""
    parts = [df.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)]
    end = df.agg((F.max(time) + F.expr("INTERVAL 61 DAYS")).alias("_end")).where("_end IS NOT NULL")
    last = [F.col("_end").alias(c) if c == time else F.lit(-1 if c == "event_id" else None).cast(t).alias(c) for c, t in df.dtypes]
    return [*parts, end.select(*last)]


def p1_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of p1 by the stream with a watermark: events arrive late and out of order, sessions come out once closed."""
    e = canonical_events(_buffer(spark, d)).select("event_id", "k", F.timestamp_millis("t").alias("time"))
    found = through_stream(_arrivals(e, "time"), lambda s: session_stream(s, key="k", time="time", gap="30 minutes", lateness="60 days"))
    return found.where("k IS NOT NULL").select(F.col("k").alias("partition_key"), F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n_events")


def p2_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each identifier once out of a stream of deliveries, whichever of its batches comes first."""
    rows = _buffer(spark, d).where("event_id IS NOT NULL AND ingested_at IS NOT NULL").select("event_id", "ingested_at")
    return through_stream(_arrivals(rows, "ingested_at"), lambda s: first_deliveries(s, within="60 days")).where("event_id > 0").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_delivered"))


def p4_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour of event time, out of a stream in which they arrive out of order."""
    e = canonical_events(_buffer(spark, d)).select("event_id", F.timestamp_millis("t").alias("time"))
    found = through_stream(_arrivals(e, "time"), lambda s: period_counts(s, time="time", cutoff="60 days"))
    return found.select(F.unix_millis("period_start").alias("period_start_ms"), "n_events")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_session_lengths, p1_stream, p2_found, p2_kept_per_batch, p2_stream, p3_found, p3_features, p3_features_chosen, p4_found, p4_hourly, p4_stream, p5_found)}

_EVENTS = """ev AS (
  SELECT DISTINCT event_id, partition_key AS k, event_time_ms AS t,
         lower(regexp_replace(event_type, '[^\\p{L}\\p{N}]', '', 'g')) AS type_key
  FROM cet_event_buffer_v5
  WHERE event_id IS NOT NULL AND partition_key <> '' AND event_type <> '' AND event_time_ms > 0)"""

_SESSIONS = f"""WITH {_EVENTS},
f AS (SELECT k, t, event_id, CASE WHEN t - lag(t) OVER w <= 1800000 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
g AS (SELECT k, t, sum(opens) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM f),
s AS (SELECT k, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_events FROM g GROUP BY k, nth)"""

_KEPT = """r AS (
  SELECT event_id, batch_id, epoch_us(ingested_at) AS arr,
         row_number() OVER (PARTITION BY event_id ORDER BY ingested_at ASC NULLS LAST, batch_id ASC NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY event_id) AS n_copies,
         max(CASE WHEN partition_key <> '' AND event_type <> '' AND event_time_ms > 0 THEN event_time_ms END) OVER (PARTITION BY event_id) AS t
  FROM cet_event_buffer_v5 WHERE event_id IS NOT NULL),
kept AS (SELECT * FROM r WHERE rn = 1)"""

_LATE = f"""WITH {_KEPT},
late AS (SELECT t // 3600000 * 3600000 AS period_start_ms, batch_id, arr - t * 1000 AS delay FROM kept WHERE t IS NOT NULL AND arr IS NOT NULL)"""

SQL: dict[str, str] = {
    "p1_found": f"{_SESSIONS} SELECT k AS partition_key, start_ms, end_ms, n_events FROM s",
    "p1_stream": f"{_SESSIONS} SELECT k AS partition_key, start_ms, end_ms, n_events FROM s",
    "p2_stream": "SELECT DISTINCT event_id, 1::bigint AS n_delivered FROM cet_event_buffer_v5 WHERE event_id > 0 AND ingested_at IS NOT NULL",
    "p4_stream": f"WITH {_EVENTS} SELECT t // 3600000 * 3600000 AS period_start_ms, count(*) AS n_events FROM ev GROUP BY 1",
    "p1_session_lengths": f"{_SESSIONS} SELECT n_events, count(*) AS n_sessions, sum(end_ms - start_ms)::bigint AS total_ms, max(end_ms - start_ms) AS longest_ms FROM s GROUP BY n_events",
    "p2_found": f"WITH {_KEPT} SELECT event_id, batch_id FROM kept WHERE n_copies > 1",
    "p2_kept_per_batch": f"WITH {_KEPT} SELECT batch_id, count(*) AS n_kept, sum(n_copies - 1)::bigint AS n_dropped FROM kept GROUP BY batch_id",
    "p3_found": f"WITH {_EVENTS} SELECT k AS partition_key, type_key, count(*) AS n_events, max(t) AS last_event_time_ms FROM ev GROUP BY ALL",
    "p3_features_chosen": f"WITH {_EVENTS} SELECT k AS partition_key, count(*) AS n_events, max(t) AS last_event_time_ms, count(DISTINCT type_key) AS n_types, "
    + ", ".join(f"count(*) FILTER (WHERE type_key = '{t}') AS n_{t}, max(t) FILTER (WHERE type_key = '{t}') AS last_{t}" for t in FEATURE_TYPES)
    + f" FROM ev WHERE type_key IN {FEATURE_TYPES} GROUP BY k",
    "p4_found": f"{_LATE} SELECT DISTINCT period_start_ms, batch_id FROM late WHERE delay > 1800000000 AND delay <= 86400000000",
    "p4_hourly": f"""{_LATE}, c AS (SELECT * FROM late WHERE delay <= 86400000000)
SELECT period_start_ms, count(*) AS n_events,
       (count(DISTINCT batch_id) FILTER (WHERE delay > 1800000000) + max(CASE WHEN delay > 1800000000 AND batch_id IS NULL THEN 1 ELSE 0 END))::bigint AS n_correcting
FROM c GROUP BY period_start_ms""",
    "p5_found": """WITH w AS (SELECT DISTINCT partition_key AS k, window_start_ms AS s, window_end_ms AS e FROM cet_impacted_windows_v2
  WHERE partition_key <> '' AND window_start_ms <= window_end_ms),
f AS (SELECT k, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM w),
g AS (SELECT k, s, e, sum(opens) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS nth FROM f),
p AS (SELECT k, min(s) AS a, max(e) AS b FROM g GROUP BY k, nth),
x AS (SELECT k, a, b, lead(a) OVER (PARTITION BY k ORDER BY a) AS nxt FROM p)
SELECT k AS partition_key, 'period' AS kind, a AS start_ms, b AS end_ms FROM x
UNION ALL SELECT k, 'gap', b, nxt FROM x WHERE nxt IS NOT NULL""",
}
