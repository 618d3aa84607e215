"""Schemas of the tables that runs read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = {
    "events": "event_id bigint, partition_key string, event_type string, event_time_ms bigint, event_time timestamp, payload string",
    "registry": "query_id string, query_version string, name string, pattern string, within_ms bigint, slide_ms bigint, enabled boolean, severity string, query_json string",
    "trends": "trend_id string, query_id string, query_version string, partition_key string, path array<bigint>, trend_start_time_ms bigint, trend_end_time_ms bigint, event_count bigint, duration_ms bigint, event_types string, risk_score double, severity string, state string",
    "partial_states": "state_id string, query_id string, query_version string, partition_key string, prefix_path array<bigint>, start_time_ms bigint, last_event_time_ms bigint, expiry_time_ms bigint",
    "impacted_windows": "query_id string, query_version string, partition_key string, window_start_ms bigint, window_end_ms bigint, source_min_event_time_ms bigint, source_max_event_time_ms bigint",
    "rejects": "dlq_id string, batch_id bigint, event_id bigint, partition_key string, error string, payload string",
    "metrics": "stream_id string, batch_id bigint, query_id string, query_version string, partition_key string, metric_name string, metric_value double",
    "kg_entities": "entity_id string, entity_type string, entity_key string, source_field string, first_seen_ms bigint, last_seen_ms bigint",
    "kg_relations": "src_entity_id string, dst_entity_id string, relation_type string, event_id bigint, event_time_ms bigint",
    "kg_evidence": "trend_id string, query_id string, event_id bigint, ordinal bigint, risk_score double",
}


def create_tables(spark: SparkSession, database: str, names: tuple[str, ...] = tuple(TABLES)) -> None:
    """Create a database and its tables, where they are missing, as parquet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({TABLES[name]}) USING parquet")


def bridge_view(spark: SparkSession, view: str, source: str) -> None:
    """A view under the name that runs read, over the table that a pipeline writes."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM {source}")
