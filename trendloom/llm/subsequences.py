"""Ordered patterns of event types that many entities' sequences share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.hot_keys import block_number, blocks_of_sizes, with_block_length
from trendloom.session import settle

_CHUNK = "split array<string>, sizes binary, times binary, kinds binary, own binary"
_WHOLE = -(2**62)  # in place of the block of a group that isn't split
_COUNTS = "code bigint, k string, n bigint"


@dataclass
class Chunk:
    """Whole groups (an entity, or a block of a split one) with their events as bit vectors.

    A group's positions are its distinct times in order; its bits start at a word of their
    own. `maps` holds one bit vector for each type over all positions, `own` the positions at
    which patterns may begin (those of a block's right margin may not), `reach` the last
    position within the window of each position, `group` the group of each word.
    """

    maps: np.ndarray
    own: np.ndarray
    reach: np.ndarray
    group: np.ndarray
    n_groups: int

    @classmethod
    def of(cls, sizes: np.ndarray, times: np.ndarray, kinds: np.ndarray, own: np.ndarray, n_kinds: int, within_ms: int) -> Chunk:
        group = np.repeat(np.arange(len(sizes)), sizes)
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (times[1:] != times[:-1])])
        first_of_group = np.concatenate([[True], group[1:] != group[:-1]])
        nth = np.cumsum(new) - 1
        local = nth - nth[np.flatnonzero(first_of_group)][group]
        n_positions = np.bincount(group[new], minlength=len(sizes))
        n_words = (n_positions + 63) >> 6
        base = np.concatenate([[0], np.cumsum(n_words)])
        bit = (base[group] << 6) + local
        words = int(base[-1])

        maps = np.zeros(n_kinds * words, np.uint64)
        flags = np.uint64(1) << (bit & 63).astype(np.uint64)
        np.bitwise_or.at(maps, kinds.astype(np.int64) * words + (bit >> 6), flags)
        mine = np.zeros(words, np.uint64)
        np.bitwise_or.at(mine, bit[own] >> 6, flags[own])

        # reach: positions of one group lie in one stretch of bits, so the search can run over all
        at, when, whose = bit[new], times[new], group[new]
        last = cls._last_within(when, whose, within_ms)
        reach = np.zeros(words << 6, np.int64)
        reach[at] = at[last]
        return cls(maps.reshape(n_kinds, words), mine, reach, np.repeat(np.arange(len(sizes)), n_words), len(sizes))

    @staticmethod
    def _last_within(when: np.ndarray, whose: np.ndarray, within_ms: int) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        low = when[starts][np.cumsum(np.concatenate([[False], whose[1:] != whose[:-1]]))]
        offset = when - low
        span = int(offset.max()) + within_ms + 1
        if span * (len(starts) + 1) < 2**62:
            line = offset + np.cumsum(np.concatenate([[False], whose[1:] != whose[:-1]])) * span
            return np.searchsorted(line, line + within_ms, side="right") - 1
        out = np.empty(len(when), np.int64)
        for i, j in zip(starts, [*starts[1:], len(when)], strict=True):
            out[i:j] = i + np.searchsorted(when[i:j], when[i:j] + within_ms, side="right") - 1
        return out

    def begin(self, a: int) -> np.ndarray:
        """Positions of type a at which a pattern may begin, in order."""
        return _positions(self.maps[a] & self.own)

    def shifted(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits (start, end] of all pairs together, as words that have any and their masks."""
        ok = end > start
        low, high = start[ok] + 1, end[ok]
        if not len(low):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first, last = low >> 6, high >> 6
        n = last - first + 1
        word = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = np.full(len(word), full)
        ends = np.cumsum(n)
        mask[ends - n] &= full << (low & 63).astype(np.uint64)
        mask[ends - 1] &= full >> (63 - (high & 63)).astype(np.uint64)
        if len(word) > 1 and (word[1:] < word[:-1]).any():
            order = np.argsort(word, kind="stable")
            word, mask = word[order], mask[order]
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return word[cut], np.bitwise_or.reduceat(mask, cut)

    def groups_with(self, kinds: np.ndarray, word: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into kinds, group), each once, where a type has a bit in the masks."""
        if not len(word) or not len(kinds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k, w = np.nonzero(self.maps[kinds[:, None], word] & mask)
        pair = np.unique(k * self.n_groups + self.group[word[w]])
        return pair // self.n_groups, pair % self.n_groups


def _positions(words: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].view(np.uint8), bitorder="little").reshape(len(at), 64)
    row, bit = np.nonzero(bits)
    return (at[row] << 6) + bit


def _extend(chunk: Chunk, a: int, follow: dict[int, np.ndarray], thirds: dict[int, dict[int, np.ndarray]] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth first below type a: (codes, groups) of the patterns in the chunk.

    Without `thirds` the patterns are pairs a, b; with it triples a, b, c, for which
    thirds[a][b] has the c to try. A position of b is taken with the latest a before it, whose
    window reaches farthest.
    """
    n = len(chunk.maps)
    start = chunk.begin(a)
    if not len(start):
        return
    word, mask = chunk.shifted(start, chunk.reach[start])
    if thirds is None:
        b, group = chunk.groups_with(follow[a], word, mask)
        yield a * n + follow[a][b], group
        return
    for b, tried in thirds.get(a, {}).items():
        bits = chunk.maps[b][word] & mask
        some = np.flatnonzero(bits)
        if not len(some):
            continue
        inner = np.unpackbits(bits[some].view(np.uint8), bitorder="little").reshape(len(some), 64)
        row, bit = np.nonzero(inner)
        at = (word[some][row] << 6) + bit
        limit = chunk.reach[start[np.searchsorted(start, at, side="left") - 1]]
        c, group = chunk.groups_with(tried, *chunk.shifted(at, limit))
        yield (a * n + b) * n + tried[c], group


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _encode(rows: int, within_ms: int):
    """Sorted events to chunks of whole groups; a group of more than `rows` events that goes on is cut by time.

    Each part of a cut group is followed by a margin: the events at most `within_ms` after its last
    own one, at which no pattern may begin. A part ends where all of them are known. So a task holds
    no more of an entity than `rows` events and those of one window.
    """

    def chunk(t: pa.Table, named: bool) -> pa.RecordBatch:
        """One record of whole groups; `named`: the first is a part of a cut group."""
        key = pa.concat_arrays(t["k"].chunks)
        code = key.dictionary_encode().indices.to_numpy()
        block = t["block"].fill_null(_WHOLE).to_numpy()
        first = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1])
        whole = block[first] == _WHOLE
        whole[0] &= not named
        names = pc.if_else(pa.array(whole), pa.scalar(None, pa.string()), key.take(pa.array(first)))
        sizes = np.diff(np.concatenate([first, [len(t)]]))
        fields = [_bytes(x) for x in (sizes.astype(np.int64), t["t"].to_numpy(), t["kind"].to_numpy().astype(np.int32), t["own"].to_numpy(zero_copy_only=False))]
        return pa.RecordBatch.from_arrays([pa.array([names.to_pylist()], pa.list_(pa.string())), *(pa.array([f], pa.binary()) for f in fields)], ["split", "sizes", "times", "kinds", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, enough, named = 0, rows, False
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size < enough:
                continue
            t = pa.Table.from_batches(held)
            key, block = t["k"], t["block"].fill_null(_WHOLE)
            cut = int(np.argmax(pc.and_(pc.equal(key, key[-1]), pc.equal(block, block[-1])).to_numpy()))
            if cut:
                yield chunk(t.slice(0, cut), named)
                named = False
            else:
                # one group: its events whose window has passed may begin patterns, the others follow
                own = t["t"].to_numpy() + within_ms < t["t"][-1].as_py()
                cut = int(own.sum())
                if cut:
                    mine = pc.and_(t["own"], pa.array(own))
                    yield chunk(t.set_column(t.schema.get_field_index("own"), "own", mine), True)
                    named = True
            held = t.slice(cut).to_batches()
            size = len(t) - cut
            enough = max(rows, 2 * size)
        if held:
            yield chunk(pa.Table.from_batches(held), named)

    return run


def _count(n_kinds: int, within_ms: int, follow, thirds):
    """Counts of a task: groups of whole entities by pattern, and (pattern, entity) of split ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow_, thirds_ = follow.value, thirds.value if thirds else None
        total: dict[int, int] = {}
        split: set[tuple[int, str]] = set()
        for b in batches:
            for row in b.to_pylist():
                c = Chunk.of(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["times"], np.int64), np.frombuffer(row["kinds"], np.int32), np.frombuffer(row["own"], bool), n_kinds, within_ms)
                names = row["split"]
                whole = np.array([x is None for x in names])
                codes, counts = [], []
                for a in follow_ if thirds_ is None else thirds_:
                    for code, group in _extend(c, a, follow_, thirds_):
                        w = whole[group]
                        if w.any():
                            one, n = np.unique(code[w], return_counts=True)
                            codes.append(one)
                            counts.append(n)
                        if not w.all():
                            split.update((int(x), names[g]) for x, g in zip(code[~w], group[~w], strict=True))
                if codes:
                    for x, n in zip(np.concatenate(codes).tolist(), np.concatenate(counts).tolist(), strict=True):
                        total[x] = total.get(x, 0) + n
        out = [(x, None, n) for x, n in total.items()] + [(x, k, 1) for x, k in sorted(split)]
        for i in range(0, len(out), 50_000):
            code, k, n = zip(*out[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(k, pa.string()), pa.array(n, pa.int64())], ["code", "k", "n"])

    return run


def _support(counts: DataFrame, need: int) -> DataFrame:
    """Entities by pattern; blocks of a split entity count once."""
    each = counts.groupBy("code", "k").agg(F.sum("n").alias("n"))
    return each.groupBy("code").agg(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(1)).alias("support")).where(F.col("support") >= need)


def type_sizes(events: DataFrame) -> DataFrame:
    """(k, type_key, n, low, high): rows, first and last time of each type of an entity; rows lacking any of these count nowhere."""
    rows = events.where("k IS NOT NULL AND t IS NOT NULL AND type_key IS NOT NULL")
    return rows.groupBy("k", "type_key").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))


def frequent_triples(
    events: DataFrame,
    *,
    within_ms: int = 600_000,
    one_in: int = 50,
    least: int = 3,
    chunk_rows: int = 150_000,
    **hot: int,
) -> DataFrame:
    """(step1, step2, step3, support): triples of three different types that at least one entity
    in `one_in`, and at least `least`, has in strictly rising order of time within `within_ms`.

    Other events may lie between; events of equal time are in no order. support is the number
    of entities. `events` are (k, t, type_key), in any order and however often each was delivered
    (copies share all three, and so their bit); rows without key, type or time are left out; no
    events give no rows.

    Method: bitmap sequence mining. Positions of events become bit vectors by type; a pattern
    is extended by shifting its positions to the bits that follow them within the window and
    intersecting these with the next type's vector, depth first; entities with a bit left are
    counted. Types and pairs below the support are left out before the triples (a pattern is
    never more frequent than its parts). What the driver holds is bounded: a frequent type or
    pair takes one entity in `one_in`, so there are at most `one_in` times as many as an
    average entity has.

    Events are read twice: for sizes by entity and type (written down), and for the chunks of bit
    vectors (written down), with one shuffle each. Whole entities are counted within tasks, so one
    row per pattern and task is shuffled. Hot entities (`blocks_of_sizes`, whose limits are the
    further options) are split into blocks of time over several tasks, and any entity of more than
    `chunk_rows` events within its task, each part with a right margin of `within_ms`; such an
    entity counts once for all its parts.
    """
    spark = events.sparkSession
    events = events.select("k", "t", "type_key")
    pairs = settle(type_sizes(events), "types")
    n_keys = pairs.select("k").distinct().count()
    need = max(least, -(-n_keys // one_in))
    kinds = sorted(r["type_key"] for r in pairs.groupBy("type_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select("type_key").collect())
    schema = "step1 string, step2 string, step3 string, support bigint"
    if len(kinds) < 3:
        return spark.createDataFrame([], schema)
    blocks = blocks_of_sizes(pairs.groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), **hot)

    names = spark.createDataFrame(list(enumerate(kinds)), "kind int, type_key string")
    e = events.where("k IS NOT NULL AND t IS NOT NULL").join(F.broadcast(names), "type_key").select("k", "t", "kind")
    if blocks:
        e = with_block_length(e, blocks)
        block, before = block_number(F.col("t"), F.col("block_ms")), block_number(F.col("t") - within_ms, F.col("block_ms"))
        own = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")))
        margin = F.when(before < block, F.transform(F.sequence(before, block - 1), lambda x: F.struct(x.alias("block"), F.lit(False).alias("own"))))
        e = e.select("k", "t", "kind", F.explode(F.when(margin.isNull(), own).otherwise(F.concat(own, margin))).alias("x")).select("k", "t", "kind", "x.block", "x.own")
    else:
        e = e.select("k", "t", "kind", F.lit(None).cast("long").alias("block"), F.lit(True).alias("own"))
    chunks = settle(e.repartition("k", "block").sortWithinPartitions("k", "block", "t").mapInArrow(_encode(chunk_rows, within_ms), _CHUNK), "chunks")

    n = len(kinds)
    everything = np.arange(n)
    follow = spark.sparkContext.broadcast({a: everything[everything != a] for a in range(n)})
    two = sorted(r["code"] for r in _support(chunks.mapInArrow(_count(n, within_ms, follow, None), _COUNTS), need).select("code").collect())
    after: dict[int, set[int]] = {}
    for code in two:
        after.setdefault(code // n, set()).add(code % n)
    tried: dict[int, dict[int, np.ndarray]] = {}
    for a, seconds in after.items():
        for b in sorted(seconds):
            c = np.array(sorted(seconds & after.get(b, set())), np.int64)
            if len(c):
                tried.setdefault(a, {})[b] = c
    thirds = spark.sparkContext.broadcast(tried)
    three = _support(chunks.mapInArrow(_count(n, within_ms, follow, thirds), _COUNTS), need)

    def named(at: str, column: str) -> DataFrame:
        return F.broadcast(names.select(F.col("kind").alias(at), F.col("type_key").alias(column)))

    parts = three.select(F.expr(f"cast(code div {n * n} as int)").alias("a"), F.expr(f"cast(code div {n} % {n} as int)").alias("b"), F.expr(f"cast(code % {n} as int)").alias("c"), "support")
    return parts.join(named("a", "step1"), "a").join(named("b", "step2"), "b").join(named("c", "step3"), "c").select("step1", "step2", "step3", F.col("support").cast("long").alias("support"))
