"""Runs of identical consecutive events, collapsed into one event each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.hot_keys import block_number, hot_blocks, with_block_length

_RUN = "k string, type_key string, start_ms bigint, end_ms bigint, n bigint, block bigint, head boolean, tail boolean"
_APART = "\x01"
_REPEATED = re.compile(f"([^{_APART}])\\1+")
_EVERY = re.compile(f"([^{_APART}])\\1*")


def symbols(codes: np.ndarray) -> np.ndarray:
    """Unicode code points of type indices: from U+0100 on, without the surrogates."""
    points = codes.astype(np.uint32) + 0x100
    return np.where(points >= 0xD800, points + 0x800, points)


def _encoded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    encoded = pa.concat_arrays(column.chunks).dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False), encoded.dictionary


def _find(t: pa.Table, most_apart_ms: int, last: bool, opened: bool) -> tuple[pa.RecordBatch, pa.Table | None, bool]:
    """Runs of a table sorted by key, block and time, the run that may go on, and whether that begins its group.

    `last`: nothing follows; `opened`: the first row continues a group begun earlier (it is not its head).
    """
    key, keys = _encoded(t["k"])
    kind, kinds = _encoded(t["type_key"])
    block = t["block"].fill_null(-(2**62)).to_numpy()
    start, end, n = (t[c].to_numpy() for c in ("s", "t", "n"))
    new_group = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    apart = new_group | np.concatenate([[True], start[1:] - end[:-1] > most_apart_ms])

    # the string: a mark before each event that can't go on a run, then the event's symbol
    marks = np.cumsum(apart)
    places = np.arange(len(t)) + marks
    points = np.full(len(t) + int(marks[-1]), ord(_APART), np.uint32)
    points[places] = symbols(kind)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    split = bool((block != -(2**62)).any())
    # single events matter at the edges of blocks, where a run may go on, and where one event stands for a run begun before
    single = split or not last or bool((n > 1).any())
    spans = np.array([m.span() for m in (_EVERY if single else _REPEATED).finditer(text)], np.int64).reshape(-1, 2)
    i = np.searchsorted(places, spans[:, 0])
    j = np.searchsorted(places, spans[:, 1] - 1)

    rest, rest_heads = None, False
    heads = new_group[i].copy() if len(i) else np.empty(0, bool)
    if opened and len(i) and i[0] == 0:
        heads[0] = False
    if not last:
        a, b = i[-1], j[-1]
        rest = pa.table({"k": t["k"].slice(a, 1), "block": t["block"].slice(a, 1), "type_key": t["type_key"].slice(a, 1), "s": [start[a]], "t": [end[b]], "n": [int(n[a : b + 1].sum())]}).cast(t.schema)
        rest_heads = bool(heads[-1])
        i, j, heads = i[:-1], j[:-1], heads[:-1]
    ends = np.concatenate([new_group[1:], [last]])
    tails = ends[j]
    total = np.concatenate([[0], np.cumsum(n)])
    count = total[j + 1] - total[i]
    in_split = block[i] != -(2**62)
    keep = (count > 1) | (in_split & (heads | tails))
    i, j, heads, tails, count, in_split = (x[keep] for x in (i, j, heads, tails, count, in_split))
    out = pa.RecordBatch.from_arrays(
        [keys.take(pa.array(key[i])), kinds.take(pa.array(kind[i])), pa.array(start[i]), pa.array(end[j]), pa.array(count), pa.array(block[i], mask=~in_split), pa.array(heads), pa.array(tails)],
        ["k", "type_key", "start_ms", "end_ms", "n", "block", "head", "tail"],
    )
    return out, rest, rest_heads


def _runs(most_apart_ms: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, opened = 0, False
        for b in batches:
            if not len(b):
                continue
            held.append(pa.Table.from_batches([b]))
            size += len(b)
            if size < rows:
                continue
            out, rest, heads = _find(pa.concat_tables(held), most_apart_ms, False, opened)
            yield out
            held, size, opened = [rest], 1, not heads
        if held:
            yield _find(pa.concat_tables(held), most_apart_ms, True, opened)[0]

    return run


def collapse_runs(events: DataFrame, *, blocks: dict[str, int] | None = None, most_apart_ms: int = 300_000, task_rows: int = 100_000) -> DataFrame:
    """Runs (k, type_key, start_ms, end_ms, duration_ms, n_events) of two or more canonical events.

    A run is a maximal stretch of neighbours in the key's order (time, then identifier) with
    the same type, each at most `most_apart_ms` after the one before. Equal times are in order
    of identifier. Rows without key, type or time are left out; no events give no runs.

    Method: events become Unicode code points by type and are concatenated per entity, with a
    mark wherever a run can't go on; a regular expression with a back reference finds the
    repetitions, and its spans give the times. A task works through its sorted entities with
    bounded memory: an unfinished run is carried on as one event. Keys in `blocks` (see
    `hot_blocks`) are split by time; only the first and last runs of their blocks, at most two
    rows a block, are then joined across blocks.
    """
    e = events.where("k IS NOT NULL AND t IS NOT NULL AND type_key IS NOT NULL")
    e = with_block_length(e, blocks).select("k", block_number(F.col("t"), F.col("block_ms")).alias("block"), "t", "event_id", "type_key")
    sorted_ = e.repartition("k", "block").sortWithinPartitions("k", "block", "t", "event_id")
    found = sorted_.select("k", "block", "type_key", F.col("t").alias("s"), "t", F.lit(1).cast("long").alias("n")).mapInArrow(_runs(most_apart_ms, task_rows), _RUN)
    columns = ["k", "type_key", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.col("n").alias("n_events")]
    if not blocks:
        return found.select(*columns)
    edge = F.col("block").isNotNull() & (F.col("head") | F.col("tail"))
    order = Window.partitionBy("k").orderBy("block", "start_ms", F.desc("head"))
    joins = F.col("head") & F.lag("tail").over(order) & (F.lag("block").over(order) != F.col("block")) & (F.lag("type_key").over(order) == F.col("type_key")) & (F.col("start_ms") - F.lag("end_ms").over(order) <= most_apart_ms)
    # one pass for both kinds of rows: a run inside a block is a group of its own
    edges = found.where(edge).withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("nth", F.sum("new").over(order))
    joined = edges.groupBy("k", "nth").agg(F.first("type_key").alias("type_key"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"))
    return found.where(~edge).select(*columns).unionByName(joined.where("n > 1").select(*columns))


def buffer_blocks(buffer: DataFrame, **options: int) -> dict[str, int]:
    """`hot_blocks` of an event buffer by partition_key and event_time_ms."""
    return hot_blocks(buffer, key="partition_key", time_ms="event_time_ms", **options)
