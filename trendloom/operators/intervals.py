"""Continuous periods of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.hot_keys import block_number, hot_blocks, with_block_length
from trendloom.session import settle

_FOUND = "k string, kind string, slice bigint, s bigint, e bigint, next_s bigint"


class IntervalMap:
    """Disjoint closed intervals in order, with the gaps between them.

    `add` finds the overlapped intervals by binary search in both bounds and puts their
    union in their place; the gaps are those between neighbours.
    """

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.ends, start)  # the first that ends at or after start
        j = bisect_right(self.starts, end)  # after the last that starts at or before end
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j] = [start]
        self.ends[i:j] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals sorted by key, slice and start through one map for each; what is merged leaves when its slice ends."""
    group, held = None, IntervalMap()
    out: list[tuple] = []

    def close() -> None:
        k, piece = group
        followers = [*held.starts[1:], None]
        if piece is None:
            out.extend((k, "period", None, a, b, None) for a, b in zip(held.starts, held.ends, strict=True))
            out.extend((k, "gap", None, a, b, None) for a, b in held.gaps())
        else:
            out.extend((k, "piece", piece, a, b, n) for a, b, n in zip(held.starts, held.ends, followers, strict=True))

    for b in batches:
        for k, piece, s, e in zip(*(b[c].to_pylist() for c in ("k", "slice", "s", "e")), strict=True):
            if (k, piece) != group:
                if group:
                    close()
                group, held = (k, piece), IntervalMap()
            held.add(s, e)
        if len(out) >= 10_000:
            yield _rows(out)
            out = []
    if group:
        close()
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = (pa.string(), pa.string(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "kind", "slice", "s", "e", "next_s"])


def periods_and_gaps(df: DataFrame, *, key: str = "partition_key", start: str = "window_start_ms", end: str = "window_end_ms", **hot: int) -> DataFrame:
    """Rows (k, kind, start_ms, end_ms): kind `period` for every continuous period of a key,
    `gap` for every hole between two consecutive periods, from the end of one to the next start.

    Intervals include both ends: one that starts at or before the end so far joins, one that
    starts 1 later does not. Rows with a null or empty key, a null bound or a start after the
    end do not count; repeated rows count once; an interval of no length is a period. An empty
    table gives no rows; extra columns are not read.

    Method: an ordered map of disjoint intervals per entity, where each insertion finds overlaps
    by binary search, merges them and thereby changes the gaps. Rows reach a map in order of start,
    so most are added at its end. Only keys with many rows (`hot_blocks`, whose limits are the
    further options) are split, into slices of start time sized by the key's count, with a map for
    each; slices are then stitched: the end reached before each (a running maximum over one row a
    slice, of which there are a few thousand at most) tells which of its first pieces an earlier
    period already holds. So a key with a third of all rows is spread over many tasks. A slice has
    a length of an hour at least, and so no more than 3.6 million different starts.
    """
    rows = df.where((F.col(key) != "") & (F.col(start) <= F.col(end))).select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    blocks = hot_blocks(rows, key="k", time_ms="s", **hot)
    sliced = with_block_length(rows, blocks).select("k", block_number(F.col("s"), F.col("block_ms")).alias("slice"), "s", "e")
    # of windows with one start only the longest matters: copies go before any of a key's rows come together
    longest = sliced.groupBy("k", "slice", "s").agg(F.max("e").alias("e"))
    found = longest.repartition("k", "slice").sortWithinPartitions("k", "slice", "s").mapInArrow(_merge, _FOUND)
    shown = ("k", "kind", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    if not blocks:
        return found.select(*shown)
    found = settle(found, "intervals")
    return found.where("kind <> 'piece'").select(*shown).unionByName(_stitched(found.where("kind = 'piece'")))


def _stitched(pieces: DataFrame) -> DataFrame:
    """Periods and gaps of the slices' pieces (k, slice, s, e, next_s): disjoint and in order within a slice."""
    earlier = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reached = pieces.groupBy("k", "slice").agg(F.max("e").alias("top")).select("k", "slice", F.max("top").over(earlier).alias("reached"))
    opens = F.coalesce(F.col("s") > F.col("reached"), F.lit(True))
    marked = pieces.join(F.broadcast(reached), ["k", "slice"]).select("k", "slice", "s", "e", opens.alias("opens"), "next_s")

    # all but a slice's last period are whole: the piece that follows begins after them
    whole = marked.where(F.col("opens") & F.col("next_s").isNotNull()).select("k", "s", "e", F.col("next_s").alias("next"))

    edges = marked.groupBy("k", "slice").agg(
        F.max(F.when(~F.col("opens"), F.col("e"))).alias("head_end"),
        F.min(F.when(F.col("opens"), F.col("s"))).alias("first_s"),
        F.max(F.when(F.col("opens"), F.col("s"))).alias("last_s"),
        F.max(F.when(F.col("opens"), F.col("e"))).alias("last_e"),
    )
    # the number of the period that reaches each slice; a slice's own last one has the next number
    numbered = edges.withColumn("carries", F.count("last_s").over(earlier))
    onward = numbered.groupBy("k", F.col("carries").alias("nth")).agg(F.max("head_end").alias("head_end"), F.min("first_s").alias("next"))
    last = (
        numbered.where(F.col("last_s").isNotNull())
        .select("k", (F.col("carries") + 1).alias("nth"), "last_s", "last_e")
        .join(onward, ["k", "nth"], "left")
        .select("k", F.col("last_s").alias("s"), F.greatest("last_e", "head_end").alias("e"), "next")
    )
    both = whole.unionByName(last)
    # one scan of the result gives periods and gaps
    return both.select(
        "k",
        F.explode(F.array(F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")), F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("next").alias("b")))).alias("x"),
    ).where(F.col("x.b").isNotNull()).select("k", "x.kind", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"))
