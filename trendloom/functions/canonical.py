"""The canonical event: event_id, partition_key, event_type, event_time_ms and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("event_id", "partition_key", "event_type", "event_time_ms")


def from_activity(events: DataFrame) -> DataFrame:
    """Canonical events of the activity table (event_id, ts, user_id, event_type, value, props)."""
    k = F.get_json_object("props", "$.k").cast("int")
    # from the parts of the wall-clock time, so that the session's zone plays no part
    ms = F.expr("unix_date(CAST(ts AS DATE)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)")
    user = F.col("user_id")
    rows = events.select(
        "event_id",
        user.cast("string").alias("partition_key"),
        "event_type",
        ms.alias("event_time_ms"),
        k.alias("k"),
        F.concat(F.lit("u"), user).alias("user_id"),
        F.concat(F.lit("h"), user % 7).alias("host_id"),
        F.concat(F.lit("s"), user, F.lit("-"), F.floor(ms / 86_400_000)).alias("session_id"),
    )
    return rows.withColumns(
        {
            "asset_id": F.when(F.col("k") % 3 != 0, F.concat(F.lit("a"), F.col("k") % 10)),
            "process_id": F.col("k") % 20,
            "parent_process_id": F.when(F.col("k") % 4 == 0, (F.col("k") + 1) % 20),
            "asset_criticality": (F.col("k") % 10).cast("double"),
        }
    )


def _json(name: str) -> Column:
    """A field of a raw JSON text, at the top or in its attribute bag; empty counts as missing."""
    bags = ["$", "$.attributes", "$.payload"]
    return F.coalesce(*(F.nullif(F.get_json_object("raw_json", f"{b}.{name}"), F.lit("")) for b in bags))


def _either(*names: str) -> Column:
    return F.coalesce(*map(_json, names))


def normalise(raw: DataFrame, source: str = "unknown", now_ms: int | None = None) -> DataFrame:
    """Canonical events of raw JSON texts (column raw_json), whatever names their fields have.

    Identifier: event_id, id or message_id, else a hash of the text (the same on every run). Key:
    partition_key, tenant_id, user_id, host_id or source_ip, else `default`. Type: event_type,
    type, eventName or activity_name, else `Unknown`. Time: event_time_ms or timestamp_ms, else
    `now_ms`, else null. The text is kept as payload. An identifier that is no number is hashed.
    """
    id_text = _either("event_id", "id", "message_id")
    hashed = F.xxhash64(F.coalesce(id_text, F.col("raw_json"))).bitwiseAND(F.lit(2**63 - 1))
    return raw.select(
        F.coalesce(id_text.try_cast("bigint"), hashed).alias("event_id"),
        F.coalesce(_either("partition_key", "tenant_id", "user_id", "host_id", "source_ip"), F.lit("default")).alias("partition_key"),
        F.coalesce(_either("event_type", "type", "eventName", "activity_name"), F.lit("Unknown")).alias("event_type"),
        F.coalesce(_either("event_time_ms", "timestamp_ms").try_cast("bigint"), F.lit(now_ms).cast("long")).alias("event_time_ms"),
        F.lit(source).alias("source_name"),
        F.col("raw_json").alias("payload"),
    )


def _adapted(event_id: Column, kind: Column, time: Column, fields: dict[str, Column]) -> list[Column]:
    rows = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]
    attributes = F.map_from_entries(F.filter(F.array(*rows), lambda r: r["value"].isNotNull()))
    return [event_id.alias("event_id"), F.coalesce(fields["user_id"], fields["host_id"], F.lit("default")).alias("partition_key"), kind.alias("event_type"), time.alias("event_time_ms"), attributes.alias("attributes")]


def _path(name: str) -> Column:
    return F.nullif(F.get_json_object("raw_json", f"${'' if name.startswith('[') else '.'}{name}"), F.lit(""))


def _millis(*names: str) -> Column:
    """The first filled field as milliseconds: a number, or a time with or without zone (UTC); 0 if neither."""
    text = F.coalesce(*map(_path, names))
    return F.coalesce(text.try_cast("bigint"), F.unix_millis(text.try_cast("timestamp")), F.lit(0).cast("long"))


def from_ecs(raw: DataFrame) -> DataFrame:
    """Canonical events of Elastic Common Schema documents (raw_json)."""
    fields = {"user_id": F.coalesce(_path("user.id"), _path("user.name")), "host_id": F.coalesce(_path("host.id"), _path("host.name")), "source_ip": _path("source.ip"), "session_id": _path("session.id")}
    key = F.coalesce(_path("event.id"), _path("event_id"))
    ident = F.coalesce(key.try_cast("bigint"), F.xxhash64(F.coalesce(key, F.col("raw_json"))).bitwiseAND(F.lit(2**63 - 1)))
    kind = F.coalesce(_path("event.action"), _path("event.category"), _path("event_type"), F.lit("Unknown"))
    return raw.select(*_adapted(ident, kind, _millis("['@timestamp']", "event_time_ms"), fields))


def from_ocsf(raw: DataFrame) -> DataFrame:
    """Canonical events of Open Cybersecurity Schema documents (raw_json)."""
    fields = {
        "user_id": F.coalesce(_path("attributes.user_id"), _path("actor.user.uid"), _path("actor.user.name")),
        "host_id": F.coalesce(_path("attributes.host_id"), _path("device.uid"), _path("device.hostname")),
        "source_ip": F.coalesce(_path("attributes.source_ip"), _path("src_endpoint.ip")),
        "cloud_account_id": F.coalesce(_path("attributes.cloud_account_id"), _path("cloud.account_uid")),
    }
    ident = F.coalesce(_path("event_id"), _path("uid"), _path("metadata.uid")).try_cast("bigint")
    kind = F.coalesce(_path("event_type"), _path("class_name"), _path("metadata.event_code"))
    return raw.select(*_adapted(ident, kind, _millis("event_time_ms", "time", "metadata.logged_time"), fields))


def checked(events: DataFrame) -> DataFrame:
    """Events with `reason`: why each is not fit to run, null for a sound one.

    Missing fields come first, then an empty type, then an identifier that occurs in several rows.
    """
    missing = F.when(F.col("event_id").isNull(), "missing event_id").when(F.col("partition_key").isNull(), "missing partition_key").when(F.col("event_type").isNull(), "missing event_type").when(F.col("event_time_ms").isNull(), "missing event_time_ms")
    copies = events.where(F.col("event_id").isNotNull()).groupBy(F.col("event_id").alias("_id")).count().where("count > 1").select("_id", F.lit(True).alias("_twice"))
    reason = F.coalesce(missing, F.when(F.col("event_type") == "", "empty event_type"), F.when(F.col("_twice"), "duplicate event_id"))
    return events.join(copies, events["event_id"] == copies["_id"], "left").withColumn("reason", reason).drop("_id", "_twice")


def sound(events: DataFrame) -> DataFrame:
    return checked(events).where("reason IS NULL").drop("reason")


def rejects(events: DataFrame) -> DataFrame:
    return checked(events).where("reason IS NOT NULL")


EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("partition_key", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("event_time_ms", T.LongType())])


def ordered(events: DataFrame) -> DataFrame:
    """Events with `position`, their place in their key's order (time, identifier), from 0."""
    w = Window.partitionBy("partition_key").orderBy("event_time_ms", "event_id")
    return events.withColumn("position", F.row_number().over(w).cast("long") - 1)
