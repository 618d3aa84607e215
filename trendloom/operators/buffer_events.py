"""Canonical events of an append-only event buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.predicates import field


def type_key(event_type: Column) -> Column:
    """`event_type` reduced to its letters and digits, in lower case."""
    return F.lower(F.regexp_replace(event_type, r"[^\p{L}\p{N}]", ""))


def is_event(key: str = "partition_key", event_type: str = "event_type", time_ms: str = "event_time_ms") -> Column:
    """True where key and type are neither null nor empty and the time is above 0; never null."""
    return F.coalesce((F.col(key) != "") & (F.col(event_type) != "") & (F.col(time_ms) > 0), F.lit(False))


def canonical_events(
    df: DataFrame,
    *,
    event_id: str = "event_id",
    key: str = "partition_key",
    event_type: str | None = "event_type",
    time_ms: str = "event_time_ms",
    fields: Sequence[str] = (),
    arrival: Sequence[str] = ("ingested_at", "batch_id"),
) -> DataFrame:
    """One row (event_id, k, t, type_key) for each event, however often it was delivered.

    Rows without an identifier, with a null or empty key or type, or with a time of 0 or
    less are no events. Copies of one event share identifier, key and time; spellings of
    the type that give the same `type_key` are one. The copies are removed on the map side
    before the shuffle, so a group of copies of any size is no hot group. Extra columns
    are not read. An empty table gives no rows.

    With `event_type=None` the type is neither checked nor kept.

    `fields` are carried along: columns of their own, else fields of the JSON text `payload`, at
    its top or in its `attributes`, as text. Of an event's copies the one that arrived last (by
    `arrival`, nulls first, then by value) among those that fill the field counts; an empty text
    is no value.
    """
    rows = df.where(F.col(event_id).isNotNull() & (F.col(key) != "") & (F.col(time_ms) > 0))
    cols = [
        F.col(event_id).cast("long").alias("event_id"),
        F.col(key).cast("string").alias("k"),
        F.col(time_ms).cast("long").alias("t"),
    ]
    if event_type is not None:
        rows = rows.where(F.col(event_type) != "")
        cols.append(type_key(F.col(event_type)).alias("type_key"))
    if not fields:
        return rows.select(*cols).distinct()
    held = [F.nullif(F.coalesce(field(rows, f), field(rows, f"attributes.{f}")).cast("string"), F.lit("")).alias(f"_f{i}") for i, f in enumerate(fields)]
    carried = rows.select(*cols, *held, F.struct(*arrival).alias("_at"))
    last = [F.max_by(f"_f{i}", F.when(F.col(f"_f{i}").isNotNull(), F.struct("_at", f"_f{i}"))).alias(f) for i, f in enumerate(fields)]
    return carried.groupBy(*(c for c in carried.columns if not c.startswith("_"))).agg(*last)
