"""Replaying late or corrected events: impacted windows, retraction, upsert, differences, state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.session import settle

if TYPE_CHECKING:
    from trendloom.engine import Options
    from trendloom.plans.spec import Registry


def changed_between(events: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Events of a given range of event time, both ends included."""
    return events.where(F.col("event_time_ms").between(start_ms, end_ms))


def changed_late(events: DataFrame, now_ms: int, lateness_ms: int, lookback_ms: int) -> DataFrame:
    """Events older than the allowed lateness, no older than the look-back."""
    return events.where((F.col("event_time_ms") >= now_ms - lookback_ms) & (F.col("event_time_ms") < now_ms - lateness_ms))


def impacted_windows(changed: DataFrame, registry: DataFrame, lateness_ms: int = 1_800_000) -> DataFrame:
    """Per active query and changed key the time to recompute: the changed events' range, wider by window and lateness.

    The changed events shrink to one row per key first; the registry (rules, not data) goes into
    the plan as literals, of which each key takes all.
    """
    ranges = changed.where(F.col("partition_key").isNotNull()).groupBy("partition_key").agg(F.min("event_time_ms").alias("source_min_event_time_ms"), F.max("event_time_ms").alias("source_max_event_time_ms")).where(F.col("source_min_event_time_ms").isNotNull())
    active = registry.where("enabled").select("query_id", "query_version", F.col("within_ms").cast("long").alias("within_ms"))
    rules = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for (c, t), v in zip(active.dtypes, r, strict=True))) for r in active.collect())).cast("array<struct<query_id:string,query_version:string,within_ms:bigint>>")
    margin = F.col("within_ms") + F.lit(lateness_ms)
    return ranges.withColumn("q", F.explode(rules)).select("*", "q.*").select(
        "query_id", "query_version", "partition_key",
        (F.col("source_min_event_time_ms") - margin).alias("window_start_ms"), (F.col("source_max_event_time_ms") + margin).alias("window_end_ms"),
        "source_min_event_time_ms", "source_max_event_time_ms",
    )


def merged_windows(windows: DataFrame) -> DataFrame:
    """(query_id, query_version, partition_key, start_ms, end_ms): the continuous periods of a query's windows in a key."""
    from trendloom.operators.intervals import periods_and_gaps

    key = F.to_json(F.struct("query_id", "query_version", "partition_key"))
    merged = periods_and_gaps(windows.withColumn("_k", key), key="_k").where("kind = 'period'")
    names = F.from_json("k", "query_id string, query_version string, partition_key string")
    return merged.select(names.alias("n"), "start_ms", "end_ms").select("n.*", "start_ms", "end_ms")


def events_in_periods(events: DataFrame, periods: DataFrame, stretch_ms: int = 86_400_000) -> DataFrame:
    """Events in a period (of `merged_windows`) of their key, once for each query that has one, with the query.

    Both sides are joined by key and stretch of time, so an event of a hot key meets only the
    periods near it. A period goes to each stretch that it touches.
    """
    near = lambda t: F.floor(t / stretch_ms)
    spans = periods.withColumn("_at", F.explode(F.sequence(near(F.col("start_ms")), near(F.col("end_ms")))))
    found = events.withColumn("_at", near(F.col("event_time_ms"))).join(spans, ["partition_key", "_at"]).where(F.col("event_time_ms").between(F.col("start_ms"), F.col("end_ms")))
    return found.select("query_id", "query_version", *events.columns)


def events_in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct events in some window of their key, with the window's query, for recomputing.

    Windows of a key and query are merged first, so that an event meets few of them.
    """
    return events_in_periods(events, merged_windows(windows))


def recompute(events: DataFrame, windows: DataFrame, registry: Registry, options: Options | None = None) -> DataFrame:
    """Trends of the enabled queries, found again in the impacted windows of their keys.

    For each query, its matcher runs over the events of its windows, each made wider by the query's
    `within_ms` on both sides: so every trend that overlaps a window is found again if it still
    holds, and what `stale_trends` misses is gone indeed. The registry is small (rules, not data).
    """
    from trendloom.engine import run
    from trendloom.plans.spec import Registry

    queries = registry.enabled()
    within = reduce(lambda other, q: F.when((F.col("query_id") == q.query_id) & (F.col("query_version") == q.version), q.within_ms).otherwise(other), queries, F.lit(None).cast("long"))
    wider = windows.withColumn("_within", within).where("_within IS NOT NULL").withColumn("window_start_ms", F.col("window_start_ms") - F.col("_within")).withColumn("window_end_ms", F.col("window_end_ms") + F.col("_within"))
    scope = settle(events_in_periods(events, settle(merged_windows(wider), "periods")), "scope")
    mine = lambda q: scope.where((F.col("query_id") == q.query_id) & (F.col("query_version") == q.version)).drop("query_id", "query_version")
    return reduce(DataFrame.unionByName, (run(mine(q), Registry((q,)), options) for q in queries))


KEYS = ("query_id", "query_version", "partition_key")


def overlapping(current: DataFrame, windows: DataFrame) -> DataFrame:
    """Active trends that overlap an impacted window of their query and key, each once."""
    w = windows.select(*KEYS, "window_start_ms", "window_end_ms").distinct()
    overlap = (F.col("trend_end_time_ms") >= F.col("window_start_ms")) & (F.col("trend_start_time_ms") <= F.col("window_end_ms"))
    on = reduce(lambda a, b: a & b, (current[k] == w[k] for k in KEYS)) & overlap
    return current.where(F.col("state") == "active").join(w, on, "left_semi")


def stale_trends(current: DataFrame, windows: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(trend_id): active trends that overlap an impacted window of their query and key and were not found again."""
    return overlapping(current, windows).select("trend_id").distinct().join(recomputed.select("trend_id"), "trend_id", "left_anti")


def retract(current: DataFrame, stale: DataFrame, changes: dict[str, Column] | None = None) -> DataFrame:
    """The table with the stale trends' state `retracted` (and other columns as given)."""
    marked = current.join(stale.select("trend_id", F.lit(True).alias("_stale")).distinct(), "trend_id", "left")
    new = {"state": F.lit("retracted"), **(changes or {})}
    return marked.select(*(F.when(F.col("_stale"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in current.columns))


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of `incoming` replace or join those of `current` with the same keys (null equals null).

    Columns in `keep` stay as they are in replaced rows. Rows of `incoming` must have distinct
    keys; columns that it lacks stay, or are null in new rows.
    """
    a, b = current.withColumn("_old", F.lit(True)).alias("a"), incoming.withColumn("_new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, on, "full_outer")

    def pick(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"a.{c}").alias(c)
        newer = F.col("_new").isNotNull()
        if c in keep:
            newer = newer & F.col("_old").isNull()
        return F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return both.select(*map(pick, current.columns))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`current` and those rows of `incoming` whose keys it lacks."""
    return current.unionByName(incoming.join(current.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the greatest by `order` (nulls lowest): an aggregate with map-side combine, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(c) for c in order))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns))


def diff_trends(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(trend_id, diff): `added`, `removed` or `common`, in one full join."""
    a = base.select("trend_id").distinct().withColumn("_a", F.lit(True))
    b = candidate.select("trend_id").distinct().withColumn("_b", F.lit(True))
    diff = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("common")
    return a.join(b, "trend_id", "full_outer").select("trend_id", diff.alias("diff"))


def replay_diff(current: DataFrame, recomputed: DataFrame, compared: Sequence[str] = ("path",)) -> DataFrame:
    """(trend_id, diff_type): stale_retract, new_insert, or changed_update where one of the `compared` columns differs."""
    side = lambda df, name: df.select("trend_id", F.struct(*compared).alias(f"_{name}"))
    a, b = side(current, "a"), side(recomputed, "b")
    kind = F.when(F.col("_b").isNull(), "stale_retract").when(F.col("_a").isNull(), "new_insert").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed_update")
    return a.join(b, "trend_id", "full_outer").select("trend_id", kind.alias("diff_type")).where("diff_type IS NOT NULL").distinct()


def validation_counts(table: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(check_name, value): recomputed, retracted and active trends after a replay."""
    states = table.agg(F.count_if(F.col("state") == "retracted").alias("retracted_count"), F.count_if(F.col("state") == "active").alias("active_after_replay_count"))
    found = recomputed.agg(F.count(F.lit(1)).alias("value")).select(F.lit("recomputed_count").alias("check_name"), "value")
    return found.unionByName(states.unpivot([], states.columns, "check_name", "value"))


def state_id() -> Column:
    """Identity of a partial trend: query, version, key and the identifiers of its prefix."""
    return F.sha2(F.concat_ws(":", "query_id", "query_version", "partition_key", F.array_join(F.transform("prefix_path", lambda x: x.cast("string")), ",")), 256)


def expire_states(states: DataFrame, watermark_ms: int) -> DataFrame:
    """States whose expiry is not before the watermark."""
    return states.where(F.col("expiry_time_ms") >= watermark_ms)


def compact_states(states: DataFrame) -> DataFrame:
    """The latest of each partial trend by last event time; of equals the one that expires later."""
    with_id = states if "state_id" in states.columns else states.withColumn("state_id", state_id())
    return latest_by(with_id, ["state_id"], ["last_event_time_ms", "expiry_time_ms"])


def ttl(states: DataFrame, updated: str, now: Column, keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, count of rows dropped) of a time to live by a timestamp column; null timestamps are kept."""
    old = F.coalesce(F.col(updated) < now - F.expr(f"INTERVAL {keep}"), F.lit(False))
    return states.where(~old), states.agg(F.count_if(old).alias("dropped"))


def cache_hits(touches: DataFrame) -> DataFrame:
    """How often each (key vertex, position in the sequence) was used."""
    return touches.groupBy("key_vertex", "seq_idx").agg(F.count(F.lit(1)).alias("hits"))
