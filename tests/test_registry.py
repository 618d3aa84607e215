import json

import __spark_entry__ as entry

REGISTRY = "query_id string, query_version string, name string, pattern string, within_ms bigint, slide_ms bigint, enabled boolean, severity string, query_json string"


def tables(spark, folder, schema, events, queries):
    """The buffer and the registry; events are (id, key, type, ms, payload, arrival in s)."""
    rows = [(i, k, y, None, t, p, a, None) for i, k, y, t, p, a in events]
    buffer = spark.createDataFrame(rows, schema.replace("ingested_at timestamp", "ingested_at long")).selectExpr("* EXCEPT (ingested_at)", "timestamp_seconds(ingested_at) AS ingested_at")
    buffer.write.parquet(f"{folder}/cet_event_buffer_v5.parquet")
    spark.createDataFrame([(q, "v1", q, p, 1000, 1000, True, "low", json.dumps({"relations": r})) for q, p, r in queries], REGISTRY).write.parquet(f"{folder}/cet_query_registry_v4.parquet")


def test_relations_of_the_registry_hold(spark, tmp_path, buffer_schema):
    host = lambda h: json.dumps({"host_id": h})
    nested = json.dumps({"attributes": {"host_id": "h2"}})
    events = [
        (1, "k", "KeyRead", 10, host("h1"), 1), (2, "k", "KeyRead", 20, nested, 1), (3, "k", "key write", 30, host("h1"), 1), (4, "k", "KeyWrite", 40, host("h2"), 1),
        (3, "k", "KeyWrite", 30, None, 9), (4, "k", "KeyWrite", 40, host("h3"), 0), (4, "k", "KeyWrite", 40, host(""), 9),
    ]
    tables(spark, tmp_path, buffer_schema, events, [("same", "KeyRead,KeyWrite", [{"field": "host_id", "op": "same"}]), ("any", "KeyRead,KeyWrite", [])])
    got = {r["query_id"]: (r["n_trends"], r["n_keys"], r["longest"]) for r in entry.queries()["registry_trends"](spark, str(tmp_path)).collect()}
    assert got == {"same": (2, 1, 2), "any": (4, 1, 2)}
