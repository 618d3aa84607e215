"""Running registries of queries over events."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.enrich import trends
from trendloom.operators.graph import RELATIONS, event_graph
from trendloom.plans.graph_match import find_graph, graph_statistics
from trendloom.plans.match import holds, match, path_text, without_absent
from trendloom.plans.spec import QuerySpec, Registry
from trendloom.plans.walk import match_walks
from trendloom.session import settle

MODES = ("standing", "walk", "graph")


@dataclass(frozen=True)
class Options:
    """How to run: the match mode, which entity fields make edges, and how far paths go in a graph (None: as far as the window)."""

    mode: str = "standing"
    plan: str = "auto"
    entity_keys: tuple[str, ...] = tuple(RELATIONS)
    max_gap_ms: int | None = None
    max_length: int | None = None
    criticality: str | None = "asset_criticality"
    fields: tuple[str, ...] = field(default=())

    @classmethod
    def from_env(cls, prefix: str = "TRENDLOOM") -> Options:
        """From <prefix>_MODE, _PLAN, _MAX_GAP_MS, _MAX_LENGTH and _ENTITY_KEYS (with commas); a number that is none, like an
        unset name, leaves the default, an unknown mode is an error."""
        get = lambda name: os.environ.get(f"{prefix}_{name}", "").strip()
        mode = get("MODE") or cls.mode
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
        number = lambda name: int(get(name)) if get(name).isdecimal() else None
        keys = tuple(k.strip() for k in get("ENTITY_KEYS").split(",") if k.strip())
        return cls(mode=mode, plan=get("PLAN") or cls.plan, max_gap_ms=number("MAX_GAP_MS"), max_length=number("MAX_LENGTH"), entity_keys=keys or cls.entity_keys)


def find(events: DataFrame, spec: QuerySpec, options: Options | None = None) -> DataFrame:
    """Valid paths (partition_key, path) of one query in the chosen mode."""
    o = options or Options()
    wanted = tuple(dict.fromkeys([*o.fields, *(r.field for r in spec.relations)]))
    if o.mode == "standing":
        return match(events, spec, wanted, o.plan)
    if o.mode == "graph":
        return _in_graph(events, spec, o, wanted, False)
    if o.mode != "walk":
        raise ValueError(f"unknown mode {o.mode!r}; one of {MODES}")
    # relations and absence look at the events that took a step, in every way of matching a walk: what lies
    # on a walk without taking a step must not hide an absent event, nor need it meet a relation
    ways = bool(spec.relations or spec.absence)
    found = match_walks(events, spec, wanted, ways=ways)
    if not ways:
        return found
    for r in spec.relations:
        found = found.where(holds(r, F.col("matched")))
    held = without_absent(found, events, spec, "matched").withColumn("ids", path_text(F.col("path")))
    return held.dropDuplicates(["partition_key", "ids"]).drop("ids", "matched")


def find_texts(events: DataFrame, spec: QuerySpec, options: Options | None = None) -> DataFrame:
    """As `find`, but a path is its identifiers with commas; a graph's walks are written so where they are found."""
    o = options or Options()
    if o.mode == "graph":
        return _in_graph(events, spec, o, tuple(dict.fromkeys(r.field for r in spec.relations)), True)
    return find(events, spec, o).select("partition_key", path_text(F.col("path")).alias("path"))


def _in_graph(events: DataFrame, spec: QuerySpec, o: Options, fields: tuple[str, ...], text: bool) -> DataFrame:
    # edges, seeds and targets all read the events of the query's types: worked out once
    named = settle(events.where(F.col("event_type").isin(spec.types())), "events")
    return find_graph(named, spec, fields, o.entity_keys, o.max_gap_ms, o.max_length, text)


def graph_of(events: DataFrame, spec: QuerySpec, options: Options) -> DataFrame:
    """The edges that a query's walks may take: between events of the types that it names. The search makes them distinct."""
    return event_graph(events.where(F.col("event_type").isin(spec.types())), options.entity_keys, options.max_gap_ms, once=False)


def run(events: DataFrame, registry: Registry, options: Options | None = None) -> DataFrame:
    """Trends of all enabled queries, one plan for each, over the same events."""
    o = options or Options()
    has = o.criticality if o.criticality in events.columns else None
    o2 = o if has is None else Options(**{**o.__dict__, "fields": tuple(dict.fromkeys([*o.fields, has]))})
    parts = [trends(find(events, q, o2), q, has) for q in registry.enabled()]
    if not parts:
        raise ValueError("no query is enabled")
    return reduce(DataFrame.unionByName, parts)


def compare(events: DataFrame, base: Registry, candidate: Registry, options: Options | None = None) -> DataFrame:
    """(trend_id, diff): what a changed registry would add, remove and keep on the same events."""
    from trendloom.operators.replay import diff_trends

    return diff_trends(run(events, base, options), run(events, candidate, options))


def stats(found: DataFrame) -> DataFrame:
    """Per query: paths, and the longest."""
    return found.groupBy("query_id", "query_version").agg(F.count(F.lit(1)).alias("paths_found"), F.max("event_count").alias("max_depth"))


def statistics(events: DataFrame, registry: Registry, options: Options | None = None, edges: DataFrame | None = None) -> DataFrame:
    """What graph runs of all enabled queries did: (query_id, query_version, partition_key, ...) of `graph_statistics`, and
    predicate_rejects, the events of a key that a query's types take but its conditions turn away.

    `edges` are taken instead of the events' own graph where they are given. A query that fails
    to be planned has one row of its own with its error, and the others go on.
    """
    o = options or Options(mode="graph")
    parts, failed = [], []
    for q in registry.enabled():
        try:
            s = graph_statistics(events, graph_of(events, q, o) if edges is None else edges, q, o.max_length)
            named = events.where(F.col("event_type").isin(q.types()) & F.col("partition_key").isNotNull())
            kept = reduce(lambda a, b: a & b, (p.column(events) for p in q.where), F.lit(True))
            turned = named.groupBy("partition_key").agg(F.count_if(~F.coalesce(kept, F.lit(False))).alias("predicate_rejects"))
            s = s.join(turned, "partition_key", "left").withColumn("predicate_rejects", F.coalesce("predicate_rejects", F.lit(0)))
            parts.append(s.select(F.lit(q.query_id).alias("query_id"), F.lit(q.version).alias("query_version"), *s.columns, F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
        except (ValueError, AnalysisException) as e:
            failed.append((q.query_id, q.version, "err", str(e)))
    if failed:
        parts.append(events.sparkSession.createDataFrame(failed, "query_id string, query_version string, status string, error string"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
