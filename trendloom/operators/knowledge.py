"""A temporal knowledge graph, timelines and summaries of trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.predicates import field

# Entity types in order, and the event fields that name them.
ENTITY_FIELDS = {"user": "user_id", "host": "host_id", "session": "session_id", "ip": "source_ip", "cloud_account": "cloud_account_id", "process": "process_id", "asset": "asset_id"}


def _named(events: DataFrame) -> DataFrame:
    """(event_id, event_time_ms, list of (order, type, key, id)) of each event's entities; null and empty values name none."""
    parts = [F.struct(F.lit(i).alias("o"), F.lit(kind).alias("entity_type"), field(events, f).cast("string").alias("entity_key"), F.lit(f).alias("source_field")) for i, (kind, f) in enumerate(ENTITY_FIELDS.items())]
    held = F.filter(F.array(*parts), lambda p: p["entity_key"].isNotNull() & (p["entity_key"] != ""))
    with_id = F.transform(held, lambda p: F.struct(p["o"], p["entity_type"], p["entity_key"], p["source_field"], F.sha2(F.concat_ws(":", p["entity_type"], p["entity_key"]), 256).alias("entity_id")))
    return events.where(F.col("event_id").isNotNull()).select("event_id", "event_time_ms", with_id.alias("entities"))


def kg_entities(events: DataFrame) -> DataFrame:
    """One row per entity: entity_id, entity_type, entity_key, first_seen_ms, last_seen_ms, source_field."""
    rows = _named(events).select("event_time_ms", F.explode("entities").alias("e"))
    return rows.groupBy("e.entity_id", "e.entity_type", "e.entity_key", "e.source_field").agg(F.min("event_time_ms").alias("first_seen_ms"), F.max("event_time_ms").alias("last_seen_ms"))


def kg_relations(events: DataFrame) -> DataFrame:
    """One row for each pair of entities that an event names, in order of their types; no shuffle."""
    pairs = F.flatten(F.transform("entities", lambda a: F.transform(F.filter("entities", lambda b: b["o"] > a["o"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = _named(events).select("event_id", "event_time_ms", F.explode(pairs).alias("p"))
    kind = F.concat(F.lit("co_observed:"), F.col("p.a.entity_type"), F.lit(":"), F.col("p.b.entity_type"))
    return rows.select(F.col("p.a.entity_id").alias("src_entity_id"), F.col("p.b.entity_id").alias("dst_entity_id"), kind.alias("relation_type"), "event_id", "event_time_ms")


def trend_evidence(trends: DataFrame) -> DataFrame:
    """One row for each event of each trend: trend_id, query_id, event_id, ordinal, risk_score (0 where missing)."""
    return trends.select("trend_id", "query_id", F.posexplode("path").alias("ordinal", "event_id"), F.coalesce(F.col("risk_score"), F.lit(0.0)).alias("risk_score")).select("trend_id", "query_id", "event_id", F.col("ordinal").cast("long").alias("ordinal"), "risk_score")


def timelines(trends: DataFrame, events: DataFrame) -> DataFrame:
    """The events of each trend in order of time, then ordinal; events that are missing have nulls and come first."""
    path = trend_evidence(trends).select("trend_id", "ordinal", "event_id")
    return path.join(events.select("event_id", "event_type", "event_time_ms", "partition_key"), "event_id", "left").select("trend_id", "ordinal", "event_id", "event_type", "event_time_ms", "partition_key")


def investigations(trends: DataFrame, events: DataFrame, techniques: dict[str, list[str]] | None = None, texts: dict[str, Sequence[str]] | None = None, fields: Sequence[str] = ("user_id", "host_id", "session_id")) -> DataFrame:
    """One package per trend: its timeline as a sorted list, techniques of its query, questions, checks and actions.

    Questions follow from the trend: for each of `fields` that all events on the path share, what
    else its value did; for one that changes along the path, why; none for a field without values.
    `texts` are the caller's own: further `questions`, `checks`, `serious_checks` (of trends that are
    high or critical) and `actions`; there are none by default.
    """
    own = dict(texts or {})
    values = events.select("event_id", *(field(events, f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)))
    path = timelines(trends, events).join(values, "event_id", "left")
    step = F.struct(F.coalesce("event_time_ms", F.lit(0)).alias("at"), "ordinal", "event_id", "event_type", "event_time_ms", "partition_key")
    spread_of = [x for i in range(len(fields)) for x in (F.min(f"_f{i}").alias(f"_low{i}"), F.max(f"_f{i}").alias(f"_high{i}"))]
    steps = path.groupBy("trend_id").agg(F.sort_array(F.collect_list(step)).alias("timeline"), *spread_of)
    listed = lambda name: F.array(*map(F.lit, own.get(name, ()))).cast("array<string>")
    asked = [
        F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.concat(F.lit(f"What else did {f} "), F.col(f"_low{i}"), F.lit(" do around this time?"))).when(F.col(f"_low{i}").isNotNull(), F.lit(f"Why does {f} change along the path?"))
        for i, f in enumerate(fields)
    ]
    questions = F.concat(F.filter(F.array(*asked).cast("array<string>"), lambda q: q.isNotNull()), listed("questions"))
    none = F.array().cast("array<string>")
    names = F.create_map(*(x for k, v in techniques.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if techniques else None
    known = none if names is None else F.coalesce(F.try_element_at(names, F.col("query_id")), none)
    checks = F.concat(listed("checks"), F.when(F.col("severity").isin("high", "critical"), listed("serious_checks")).otherwise(none))
    return trends.join(steps, "trend_id", "left").select("trend_id", "query_id", "severity", "risk_score", "timeline", known.alias("techniques"), questions.alias("questions"), checks.alias("checks"), listed("actions").alias("actions"))
