import os
import re
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 6)} <= set(entry.queries())


def test_core_does_not_import_llm():
    for folder, _, files in os.walk(os.path.join(HERE, "trendloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as x:
                    assert not re.search(r"(from|import) trendloom\.llm|from trendloom import llm", x.read()), f


def test_entry_imports_without_llm():
    code = "import sys; sys.modules['trendloom.llm'] = None; import __spark_entry__ as e; print(sum(k.startswith('p6') for k in e.queries()), 'p1_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "True"]


def test_flagship(spark, tmp_path, monkeypatch):
    rows = [(i, 1, kind) for i, kind in enumerate(["click", "view", "purchase"])]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,event_id) AS ts", "user_id", "event_type", "1.0D AS value", "concat('{\"k\": ', event_id, '}') AS props")
    df.write.parquet(str(tmp_path / "events.parquet"))
    assert [r["path"] for r in entry.queries()["seq3_any_1d"](spark, str(tmp_path)).collect()] == ["0,1,2"]
    df.limit(0).write.parquet(str(tmp_path / "empty" / "events.parquet"))
    for name in ("seq3_any_1d", "seq_kleene_3d", "walk_kleene_mid", "edges_entity", "multi_query", "kg_relations", "window_assign"):
        assert entry.queries()[name](spark, str(tmp_path / "empty")).count() == 0, name
