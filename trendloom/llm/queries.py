"""Queries p6 to p10 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.byte_pairs import encode_texts
from trendloom.llm.leaks import leaked_items, reparameterised_items
from trendloom.llm.lookalike import SHAPES, canonical_texts, look_classes, look_pairs
from trendloom.llm.runs import buffer_blocks, collapse_runs
from trendloom.llm.subsequences import frequent_triples
from trendloom.operators.buffer_events import canonical_events, is_event, type_key
from trendloom.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # copies of an event share key, time and type, so they need not be taken out
    buffer = table(spark, d, "cet_event_buffer_v5").where(is_event() & F.col("event_id").isNotNull())
    return frequent_triples(buffer.select(F.col("partition_key").alias("k"), F.col("event_time_ms").alias("t"), type_key(F.col("event_type")).alias("type_key")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    buffer = table(spark, d, "cet_event_buffer_v5")
    runs = collapse_runs(canonical_events(buffer), blocks=buffer_blocks(buffer))
    return runs.select(F.col("k").alias("partition_key"), "type_key", "start_ms", "end_ms", "n_events")


def p7_longest_runs(spark: SparkSession, d: str) -> DataFrame:
    """By type: number of runs, events in them, and the most events and longest duration of a run."""
    buffer = table(spark, d, "cet_event_buffer_v5")
    runs = collapse_runs(canonical_events(buffer), blocks=buffer_blocks(buffer))
    return runs.groupBy("type_key").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("most_events"), F.max("duration_ms").alias("longest_ms"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item with other numbers, names or units."""
    return reparameterised_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_pairs(canonical_texts(table(spark, d, "documents")))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like others stored otherwise: class and number of links, one row for each."""
    return look_classes(canonical_texts(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p7_found, p7_longest_runs, p8_ids, p9_found, p9_reparameterised, p10_found, p10_classes)}



def _look_sql() -> str:
    """Texts by what they look like, as SQL: the shapes by translation and replacement, joined by composition (nfc_normalize).

    Made of the same table of shapes, but without tokens, trie or vocabulary: letters that look like
    several are read as the table reads them.
    """
    plain, gone, joined = {}, [], {}
    for c in range(0x80, 0x20000):
        x = chr(c)
        if unicodedata.category(x) in ("Cs", "Co", "Cn"):
            continue
        shape = unicodedata.normalize("NFC", SHAPES[c])
        if shape == unicodedata.normalize("NFC", x):
            continue
        if not shape:
            gone.append(x)
        elif len(shape) == 1:
            plain[x] = shape
        else:
            joined[x] = shape
    quoted = lambda t: t.replace("'", "''")
    text = "text"
    # a joiner between two signs shows, so it is set aside; twice, since signs may stand in a row
    sign = "[\\x{2600}-\\x{27bf}\\x{fe0f}\\x{1f000}-\\x{1faff}]"
    for _ in range(2):
        text = f"regexp_replace({text}, '({sign})\\x{{200d}}({sign})', '\\1\ue0ff\\2', 'g')"
    text = f"translate({text}, '{quoted(''.join([*plain, *gone]))}', '{quoted(''.join(plain.values()))}')"
    # joined letters and signs: few texts have any, so the chain of replacements is for these
    rare = f"regexp_matches(t, '[{''.join(f'\\x{{{ord(x):x}}}' for x in joined)}]')"
    chain = "t"
    for x, shape in joined.items():
        chain = f"replace({chain}, '{x}', '{quoted(shape)}')"
    return f"""WITH d AS (SELECT doc_id, text, {text} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, nfc_normalize(t) AS look FROM d WHERE NOT {rare} UNION ALL SELECT doc_id, text, nfc_normalize({chain}) FROM d WHERE {rare}),
f AS (SELECT * FROM l WHERE NOT regexp_full_match(look, '\\s*'))"""


_RUNS = """WITH ev AS (
  SELECT DISTINCT event_id, partition_key AS k, event_time_ms AS t, lower(regexp_replace(event_type, '[^\\p{L}\\p{N}]', '', 'g')) AS type_key
  FROM cet_event_buffer_v5
  WHERE event_id IS NOT NULL AND partition_key <> '' AND event_type <> '' AND event_time_ms > 0),
f AS (SELECT *, CASE WHEN type_key = lag(type_key) OVER w AND t - lag(t) OVER w <= 300000 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM f),
runs AS (SELECT k AS partition_key, any_value(type_key) AS type_key, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_events FROM g GROUP BY k, nth HAVING count(*) > 1)"""

SQL: dict[str, str] = {
    "p6_found": """WITH ev AS (
  SELECT DISTINCT partition_key AS k, event_time_ms AS t, lower(regexp_replace(event_type, '[^\\p{L}\\p{N}]', '', 'g')) AS y
  FROM cet_event_buffer_v5
  WHERE event_id IS NOT NULL AND partition_key <> '' AND event_type <> '' AND event_time_ms > 0),
need AS (SELECT greatest(3, (count(DISTINCT k) + 49) // 50) AS n FROM ev),
ab AS (SELECT a.k, a.y AS y1, b.y AS y2, b.t AS t2, max(a.t) AS t1 FROM ev a JOIN ev b ON a.k = b.k AND b.t > a.t AND b.t - a.t <= 600000 AND a.y <> b.y GROUP BY ALL),
f2 AS (SELECT y1, y2 FROM ab GROUP BY ALL HAVING count(DISTINCT k) >= (SELECT n FROM need)),
abf AS (SELECT ab.* FROM ab JOIN f2 USING (y1, y2)),
abc AS (SELECT DISTINCT p.k, p.y1, p.y2, c.y AS y3 FROM abf p JOIN ev c ON p.k = c.k AND c.t > p.t2 AND c.t - p.t1 <= 600000 AND c.y <> p.y1 AND c.y <> p.y2)
SELECT y1 AS step1, y2 AS step2, y3 AS step3, count(*) AS support FROM abc GROUP BY ALL HAVING count(*) >= (SELECT n FROM need)""",
    "p10_found": f"{_look_sql()} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": f"{_look_sql()}, n AS (SELECT doc_id, text, look, count(*) OVER (PARTITION BY look) - count(*) OVER (PARTITION BY look, text) AS n_links, min(doc_id) OVER (PARTITION BY look) AS class_id FROM f) SELECT doc_id, class_id, n_links FROM n WHERE n_links > 0",
    "p7_found": f"{_RUNS} SELECT * FROM runs",
    "p7_longest_runs": f"{_RUNS} SELECT type_key, count(*) AS n_runs, sum(n_events)::bigint AS n_events, max(n_events) AS most_events, max(end_ms - start_ms) AS longest_ms FROM runs GROUP BY type_key",
}
