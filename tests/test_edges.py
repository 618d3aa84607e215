import __spark_entry__ as entry


def test_edges_of_every_entity_field(spark, tmp_path):
    rows = [(1, 1, "click"), (2, 1, "view"), (3, 1, "purchase")]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,event_id) AS ts", "user_id", "event_type", "1.0D AS value", "'{\"k\": 4}' AS props")
    df.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("edges_entity_all", "edges_max_gap_all", "path_edge_evidence_all"):
        assert {"same_user", "same_process", "same_host"} <= {r["relation"] for r in entry.queries()[name](spark, str(tmp_path)).collect()}, name
