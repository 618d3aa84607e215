"""Features, entities, scores and identity of matched paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.plans.match import path_text
from trendloom.plans.spec import QuerySpec

# Score of a severity, lower bound of a severity by score, entity fields and their buckets.
SEVERITY_BASE = {"info": 10.0, "low": 25.0, "medium": 50.0, "high": 75.0, "critical": 90.0}
SEVERITY_BANDS = (("critical", 90), ("high", 75), ("medium", 50), ("low", 25))
BUCKETS = {"user_id": "users", "host_id": "hosts", "session_id": "sessions", "source_ip": "ips", "asset_id": "assets", "cloud_account_id": "cloud_accounts", "process_id": "processes"}


def trend_id(query_id: Column, version: Column, key: Column, ids_text: Column) -> Column:
    """SHA-256 of query, version, key and the path's identifiers."""
    return F.sha2(F.concat_ws(":", query_id, version, key, ids_text), 256)


def times(path: Column) -> Column:
    return F.transform(path, lambda e: e["t"])


def features(path: Column) -> Column:
    """Count, first and last time, duration, types in order, and distinct types."""
    low, high = F.array_min(times(path)), F.array_max(times(path))
    types = F.transform(path, lambda e: e["y"])
    return F.struct(
        F.size(path).cast("long").alias("event_count"),
        low.alias("trend_start_time_ms"),
        high.alias("trend_end_time_ms"),
        (high - low).alias("duration_ms"),
        types.alias("event_types"),
        F.array_sort(F.array_distinct(types)).alias("distinct_event_types"),
    )


def entities(path: Column, fields: tuple[str, ...]) -> Column:
    """A map from bucket to the sorted distinct values that the path's events have; empty buckets are left out."""
    def values(f: str) -> Column:
        filled = F.filter(F.transform(path, lambda e: e[f].cast("string")), lambda v: v.isNotNull() & (v != ""))
        return F.array_sort(F.array_distinct(filled))

    rows = [F.struct(F.lit(BUCKETS[f]).alias("key"), values(f).alias("value")) for f in fields if f in BUCKETS]
    return F.map_from_entries(F.filter(F.array(*rows), lambda r: F.size(r["value"]) > 0))


def severity_of(score: Column) -> Column:
    out = F.lit("info")
    for name, least in reversed(SEVERITY_BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def risk(path: Column, severity: Column, criticality: str | None, boost: float = 0.0, overflow: Column | None = None) -> Column:
    """Score, severity and their terms: the severity's base, a bonus for length, the greatest criticality on the path, a boost, a penalty for overflow; within 0 and 100."""
    bases = F.create_map(*(x for k, v in SEVERITY_BASE.items() for x in (F.lit(k), F.lit(v))))
    base = F.coalesce(F.try_element_at(bases, F.lower(severity)), F.lit(SEVERITY_BASE["medium"]))
    bonus = F.least(F.lit(10.0), F.greatest(F.size(path) - 2, F.lit(0)) * F.lit(2.0))
    critical = F.lit(0.0) if criticality is None else F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(path, lambda e: e[criticality].cast("string").try_cast("double"))), F.lit(0.0)))
    penalty = F.lit(0.0) if overflow is None else F.when(overflow, -10.0).otherwise(0.0)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), base + bonus + critical + F.lit(float(boost)) + penalty))
    terms = F.struct(base.alias("base"), bonus.alias("path_bonus"), critical.alias("asset_criticality_bonus"), F.lit(float(boost)).alias("manual_boost"), penalty.alias("overflow_penalty"))
    return F.struct(score.alias("risk_score"), severity_of(score).alias("severity"), terms.alias("explanation"))


def trends(paths: DataFrame, spec: QuerySpec, criticality: str | None = None) -> DataFrame:
    """Trend rows of matched paths: identity, path, times, score, severity, features, state `active`; each trend once."""
    text = path_text(F.col("path"))
    named = paths.select(
        trend_id(F.lit(spec.query_id), F.lit(spec.version), F.col("partition_key"), text).alias("trend_id"),
        F.lit(spec.query_id).alias("query_id"),
        F.lit(spec.version).alias("query_version"),
        "partition_key",
        "path",
        features(F.col("path")).alias("f"),
        risk(F.col("path"), F.lit(spec.severity), criticality, float((spec.score or {}).get("boost", 0.0))).alias("r"),
    )
    return named.select(
        "trend_id", "query_id", "query_version", "partition_key",
        F.transform("path", lambda e: e["id"]).alias("path"),
        "f.trend_start_time_ms", "f.trend_end_time_ms", "f.event_count", "f.duration_ms",
        F.array_join("f.event_types", ",").alias("event_types"),
        "r.risk_score", "r.severity", F.lit("active").alias("state"),
    )
