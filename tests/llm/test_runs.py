import random

import pytest

from trendloom.llm.runs import collapse_runs, symbols
from trendloom.operators.hot_keys import hot_blocks


def brute(events, most):
    out = []
    for k in sorted({e[1] for e in events}):
        line = sorted((t, i, y) for i, x, t, y in events if x == k)
        run = [line[0]]
        for a, b in zip(line, line[1:]):
            if b[2] == a[2] and b[0] - a[0] <= most:
                run.append(b)
                continue
            if len(run) > 1:
                out.append((k, run[0][2], run[0][0], run[-1][0], len(run)))
            run = [b]
        if len(run) > 1:
            out.append((k, run[0][2], run[0][0], run[-1][0], len(run)))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in collapse_runs(df, **options).select("k", "type_key", "start_ms", "end_ms", "n_events").collect())


@pytest.mark.parametrize("task_rows", [1, 7, 50, 100_000])
@pytest.mark.parametrize("split", [False, True])
def test_against_brute_force(spark, task_rows, split):
    rng = random.Random(6)
    events = [(i, rng.choice("abcd"), rng.randint(1, 300), rng.choice(["x", "x", "y"])) for i in range(250)]
    events += [(1000 + i, "hot", rng.randint(1, 1500), rng.choice("xxxxy")) for i in range(600)]
    events += [(5000 + i, "one", 10 * i, "x") for i in range(80)] + [(9001, "z", 1, "\U0001f600"), (9002, "z", 1, "\U0001f600"), (9003, "z", 12, "\U0001f600")]
    df = spark.createDataFrame(events, "event_id bigint, k string, t bigint, type_key string")
    df = df.selectExpr("*", "1 AS block", "'c' AS head", "2 AS n")
    blocks = {"hot": 37, "one": 25} if split else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert found(df, blocks=blocks, most_apart_ms=10, task_rows=task_rows) == brute(events, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1, "x"), (2, "k", None, "x"), (3, "k", 1, None), (4, "k", 1, "x"), (5, "k", 1, "x")], "event_id bigint, k string, t bigint, type_key string")
    assert found(df) == [("k", "x", 1, 1, 2)]
    assert found(df.limit(0)) == []
    assert hot_blocks(df, key="k", time_ms="t") == {}


def test_symbols_avoid_surrogates():
    import numpy as np

    points = symbols(np.arange(60_000))
    assert len(set(points.tolist())) == 60_000
    assert not ((points >= 0xD800) & (points < 0xE000)).any()
