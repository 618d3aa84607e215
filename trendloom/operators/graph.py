"""Edges between events: consecutive in a key, sharing an entity, parent and child processes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.predicates import field

# Entity fields and the relation that sharing each gives.
RELATIONS = {
    "user_id": "same_user",
    "host_id": "same_host",
    "session_id": "same_session",
    "source_ip": "same_source_ip",
    "cloud_account_id": "same_cloud_account",
    "process_id": "same_process",
    "asset_id": "same_asset",
}


def _edge(src: Column, dst: Column, start: Column, end: Column, relation: Column, evidence: Column) -> list[Column]:
    return [src.alias("src"), dst.alias("dst"), relation.alias("relation"), start.alias("window_start_ms"), end.alias("window_end_ms"), evidence.alias("evidence")]


def _finish(edges: DataFrame, max_gap_ms: int | None, once: bool = True) -> DataFrame:
    """No loops, no gap beyond the limit, and (unless a later step does that) each (src, dst, relation) once."""
    kept = edges.where("src <> dst")
    if max_gap_ms is not None:
        kept = kept.where(F.col("window_end_ms") - F.col("window_start_ms") <= max_gap_ms)
    if not once:
        return kept
    return kept.groupBy("src", "dst", "relation").agg(F.min("window_start_ms").alias("window_start_ms"), F.max("window_end_ms").alias("window_end_ms"), F.min("evidence").alias("evidence"))


def _nodes(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_id").isNotNull() & F.col("event_time_ms").isNotNull())


DAY_MS = 86_400_000


def with_next(rows: DataFrame, keys: list[str], block_ms: int = DAY_MS) -> DataFrame:
    """Rows (event_id, event_time_ms, ...) with `n` and `nt`, the next event of the same keys by (time, identifier), null for the last.

    In two levels, so that a key with a third of all rows is spread over its blocks of time: the next
    one within the block, and for a block's last event the first one of the next block that has any.
    """
    event = F.struct(F.col("event_time_ms").alias("t"), F.col("event_id").alias("id"))
    inside = Window.partitionBy(*keys, "_at").orderBy("event_time_ms", "event_id")
    placed = rows.withColumn("_at", F.floor(F.col("event_time_ms") / block_ms)).withColumn("_next", F.lead(event).over(inside)).withColumn("_nth", F.row_number().over(inside))
    heads = placed.where("_nth = 1").select(*keys, "_at", event.alias("_head"))
    after = heads.select(*keys, "_at", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_at")).alias("_later"))
    both = placed.alias("a").join(after.alias("b"), reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_at"])), "left")
    following = F.coalesce("_next", "_later")
    return both.select(*(F.col(f"a.{c}") for c in rows.columns), following["id"].alias("n"), following["t"].alias("nt"))


def temporal_edges(events: DataFrame, max_gap_ms: int | None = None, once: bool = True) -> DataFrame:
    """`temporal_next` from each event to the next of its key by (time, identifier)."""
    rows = with_next(_nodes(events).select("partition_key", "event_id", "event_time_ms"), ["partition_key"])
    return _finish(rows.where(F.col("n").isNotNull()).select(*_edge(F.col("event_id"), F.col("n"), F.col("event_time_ms"), F.col("nt"), F.lit("temporal_next"), F.col("partition_key"))), max_gap_ms, once)


def chain_edges(events: DataFrame) -> DataFrame:
    """Consecutive events of a key, each edge with the time of the whole key as its window."""
    nodes = _nodes(events).select("partition_key", "event_id", "event_time_ms")
    spans = nodes.groupBy(F.col("partition_key").alias("key")).agg(F.min("event_time_ms").alias("window_start_ms"), F.max("event_time_ms").alias("window_end_ms"))
    rows = with_next(nodes, ["partition_key"]).where(F.col("n").isNotNull())
    return rows.join(spans, F.col("partition_key").eqNullSafe(F.col("key"))).select(F.col("event_id").alias("src"), F.col("n").alias("dst"), "window_start_ms", "window_end_ms")


def entity_values(events: DataFrame, keys: tuple[str, ...] = tuple(RELATIONS)) -> DataFrame:
    """One row (event_id, event_time_ms, entity, value) for each entity field that an event fills."""
    present = [k for k in keys]
    pairs = F.array(*(F.struct(F.lit(k).alias("entity"), field(events, k).cast("string").alias("value")) for k in present))
    rows = _nodes(events).select("event_id", F.col("event_time_ms"), F.explode(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))).alias("p"))
    return rows.select("event_id", "event_time_ms", "p.entity", "p.value")


def _relation(entity: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, entity), F.concat(F.lit("same_"), entity))


def entity_edges(events: DataFrame, keys: tuple[str, ...] = tuple(RELATIONS), max_gap_ms: int | None = None, once: bool = True) -> DataFrame:
    """From each event to the next one, in any key, that shares an entity; null and empty values share nothing."""
    rows = with_next(entity_values(events, keys), ["entity", "value"])
    return _finish(rows.where(F.col("n").isNotNull()).select(*_edge(F.col("event_id"), F.col("n"), F.col("event_time_ms"), F.col("nt"), _relation(F.col("entity")), F.col("value"))), max_gap_ms, once)


def parent_edges(events: DataFrame, max_gap_ms: int | None = None, once: bool = True) -> DataFrame:
    """`parent_process`: to each event from the latest one, by (time, identifier), whose process is its parent's, at or before it.

    An as-of join: processes and children of one process id in one order, and the last process seen
    so far; within blocks of time first, then over the last process of each block, so a busy process
    is spread over its blocks.
    """
    rows = _nodes(events).select(F.col("event_id"), F.col("event_time_ms"), field(events, "process_id").cast("string").alias("pid"), field(events, "parent_process_id").cast("string").alias("parent"))
    processes = rows.where("pid IS NOT NULL").select(F.col("pid").alias("p"), F.col("event_time_ms").alias("t"), F.lit(0).alias("child"), F.col("event_id").alias("id"))
    children = rows.where("parent IS NOT NULL").select(F.col("parent").alias("p"), F.col("event_time_ms").alias("t"), F.lit(1).alias("child"), F.col("event_id").alias("id"))
    line = processes.unionByName(children).withColumn("at", F.floor(F.col("t") / DAY_MS))
    inside = Window.partitionBy("p", "at").orderBy("t", "child", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("child") == 0, F.struct("id", "t")), ignorenulls=True)
    placed = line.withColumn("parent", seen.over(inside))
    ends = processes.withColumn("at", F.floor(F.col("t") / DAY_MS)).groupBy("p", "at").agg(F.max_by(F.struct("id", "t"), F.struct("t", "id")).alias("end"))
    # a block's children may come before its first process, and a block may hold children alone: each takes the last block before it
    blocks = line.select("p", "at").distinct().join(ends, ["p", "at"], "left")
    earlier = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("p", "at", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    found = placed.where("child = 1").join(carried, ["p", "at"], "left").withColumn("parent", F.coalesce("parent", "carried")).where("parent IS NOT NULL")
    return _finish(found.select(*_edge(F.col("parent.id"), F.col("id"), F.col("parent.t"), F.col("t"), F.lit("parent_process"), F.col("p"))), max_gap_ms, once)


def all_pair_edges(events: DataFrame, key: str, max_gap_ms: int) -> DataFrame:
    """Between all events that share a value of `key` and lie within `max_gap_ms`, from the earlier by (time, identifier).

    This many edges are what the question asks for; stretches of the gap's length as a second
    join key keep the join from comparing a value's whole history.
    """
    rows = entity_values(events, (key,)).withColumn("at", F.floor(F.col("event_time_ms") / max(1, max_gap_ms)))
    a = rows.select(F.col("value").alias("v"), F.col("at"), F.col("event_id").alias("src"), F.col("event_time_ms").alias("window_start_ms"))
    b = rows.select(F.col("value").alias("v"), F.explode(F.array("at", F.col("at") - 1)).alias("at"), F.col("event_id").alias("dst"), F.col("event_time_ms").alias("window_end_ms"))
    later = (F.col("window_end_ms") > F.col("window_start_ms")) | ((F.col("window_end_ms") == F.col("window_start_ms")) & (F.col("dst") > F.col("src")))
    near = F.col("window_end_ms") - F.col("window_start_ms") <= max_gap_ms
    return a.join(b, ["v", "at"]).where(later & near).select("src", "dst", F.lit(RELATIONS.get(key, f"same_{key}")).alias("relation"), "window_start_ms", "window_end_ms", F.col("v").alias("evidence"))


def event_graph(events: DataFrame, keys: tuple[str, ...] = tuple(RELATIONS), max_gap_ms: int | None = None, once: bool = True) -> DataFrame:
    """Temporal, entity and parent edges together; without `once` parallel edges of a relation may repeat."""
    parts = [temporal_edges(events, max_gap_ms, once), parent_edges(events, max_gap_ms, once)]
    return reduce(DataFrame.unionByName, [*parts, entity_edges(events, keys, max_gap_ms, once)] if keys else parts)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(trend_id, ordinal, src, dst, relation, evidence): the edges between consecutive events of each path."""
    pairs = paths.select("trend_id", F.posexplode(F.arrays_zip(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))).alias("src"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))).alias("dst"))).alias("ordinal", "p"))
    return pairs.select("trend_id", F.col("ordinal").cast("long").alias("ordinal"), "p.src", "p.dst").join(edges.select("src", "dst", "relation", "evidence"), ["src", "dst"]).select("trend_id", "ordinal", "src", "dst", "relation", "evidence")


def mutation_log(changes: DataFrame) -> DataFrame:
    """Changes (seq, op, event_id, partition_key, event_time_ms) as a log (op, event_id, partition_key, revision, happened_at_ms).

    The revision counts the changes of a key in order of `seq`; `op` is `upsert` unless it is `delete`.
    """
    w = Window.partitionBy("partition_key").orderBy("seq")
    op = F.when(F.col("op") == "delete", "delete").otherwise("upsert")
    return changes.select(op.alias("op"), "event_id", "partition_key", F.row_number().over(w).cast("long").alias("revision"), F.col("event_time_ms").alias("happened_at_ms"))


def current_events(changes: DataFrame) -> DataFrame:
    """The events that a log of changes leaves: the last change of each identifier, unless it is a `delete`."""
    rest = [c for c in changes.columns if c != "event_id"]
    last = changes.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return last.select("event_id", *(f"x.{c}" for c in rest)).where("op IS DISTINCT FROM 'delete'").drop("op", "seq")
