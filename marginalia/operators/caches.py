"""Replay of cache accesses: time to live, least-recently-used eviction, and both together.

Every miss is followed by a write of its key. All replays are exact. Rows stay distributed: what a block of the trace
passes on to the next is one row per block (time to live) or a table of at most ``capacity`` rows per block that is merged
by joins (eviction); the driver sees one row per block at most.

Edge cases: null keys and times are dropped; ties in time go by ``seq``; rows that are repeated whole count each (callers
drop them first); an empty trace gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import broadcast_if_small, cut

#: Rows of a trace in one block, about.
BLOCK_ROWS = 500_000
#: Block numbers up to this many rows (16 bytes each) are broadcast.
BROADCAST_BLOCKS = 1_000_000
#: Later than any instant, in microseconds.
NEVER = 1 << 62


def expired(written: Column, ttl: Column, now: Column) -> Column:
    """Whether an entry's time to live (seconds; none or 0 means for ever) has passed; the last instant still counts."""
    return F.coalesce((ttl > 0) & (now > written + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ttl)), F.lit(False))


def _lives(ttl: str, default_ttl: int) -> Column:
    """Microseconds that an entry lives; a time to live of 0 or below never ends, null takes the default."""
    life = F.coalesce(F.col(ttl), F.lit(default_ttl)).cast("bigint") * 1_000_000
    return F.when(life <= 0, F.lit(NEVER // 2)).otherwise(life)


def _replay_key(batches: Iterator[pa.RecordBatch], entering: dict[int, int]) -> Iterator[tuple[pa.RecordBatch, list[bool], int]]:
    """(batch, hits, instant up to which the last key's entry lives) of rows k, t, seq, life, kept, part in order.

    ``entering`` holds, by block, the instant up to which the entry of the block's first key lives at its start.
    """
    key, until = None, -NEVER
    for batch in batches:
        hits = []
        for k, t, life, kept, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if k != key:
                until = entering.get(part, -NEVER) if key is None else -NEVER
                key = k
            hit = kept and t <= until
            if not hit:
                until = t + life
            hits.append(hit)
        yield batch, hits, until


def _ttl_blocks(rows: DataFrame, blocks: int | None) -> DataFrame:
    """Hits of rows (k, t, seq, life, kept): an access is a hit iff it is ``kept`` and the entry of the last miss lives.

    Rows are range-partitioned by key and time, so at a block's start only its first key can have an entry. Every block is
    replayed as if it had none; a block whose entry turns out otherwise and that holds one key only is replayed again, as
    long as what it passes on changes. Chains of misses soon fall together, so this ends after few rounds; the worst case
    is one round per block of the largest key.
    """
    spark = rows.sparkSession
    n = blocks or max(1, spark.sparkContext.defaultParallelism, rows.count() // BLOCK_ROWS)
    rows = cut(rows.repartitionByRange(n, "k", "t", "seq").sortWithinPartitions("k", "t", "seq").withColumn("part", F.spark_partition_id()))

    def ends(part_of: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = last = part = None
            until = -NEVER
            for batch, _, until in _replay_key(batches, part_of):
                if batch.num_rows:
                    first = batch.column(0)[0].as_py() if first is None else first
                    last, part = batch.column(0)[batch.num_rows - 1].as_py(), batch.column(5)[0].as_py()
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), pa.array([until], pa.int64())], names=["part", "first", "last", "until"])

        return run

    schema = "part int, first string, last string, until bigint"
    state = {r["part"]: r for r in rows.mapInArrow(ends({}), schema).collect()}  # one row per block
    out = {p: r["until"] for p, r in state.items()}
    entering: dict[int, int] = {}
    while True:
        changed, before = {}, None
        for p in sorted(state):
            if before is not None and state[before]["last"] == state[p]["first"] and entering.get(p) != out[before]:
                changed[p] = out[before]
            before = p
        entering |= changed
        again = [p for p in changed if state[p]["first"] == state[p]["last"]]
        if not again:
            break
        for r in rows.filter(F.col("part").isin(again)).mapInArrow(ends(entering), schema).collect():
            out[r["part"]] = r["until"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits, _ in _replay_key(batches, entering):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(hits, pa.bool_())], names=["k", "seq", "kept", "hit"])

    return rows.mapInArrow(replay, "k string, seq bigint, kept boolean, hit boolean")


def ttl_replay(accesses: DataFrame, key: str = "cache_key", order: tuple[str, str] = ("ts", "seq"), ttl: str = "ttl", default_ttl: int = 3600, partitions: int | None = None) -> DataFrame:
    """(key, seq, hit BOOLEAN): an access is a hit iff it falls within the time to live of the last miss of its key."""
    ts, seq = order
    rows = accesses.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(seq).cast("bigint").alias("seq"), _lives(ttl, default_ttl).alias("life"), F.lit(True).alias("kept"))
    return _ttl_blocks(rows, partitions).select(F.col("k").alias(key), "seq", "hit")


def _starts(rows: DataFrame, capacity: int) -> DataFrame:
    """(block, k, pos): the cache at every block's start, the ``capacity`` keys used last before it.

    The keys used last in each block are merged with those of the blocks before, twice as far back in each round, until a
    block's cache is full or the trace's start is reached. A round joins at most ``capacity`` rows per block.
    """
    w = Window.partitionBy("block").orderBy(F.desc("pos"))

    def top(df: DataFrame) -> DataFrame:
        last = df.groupBy("block", "k").agg(F.max("pos").alias("pos"))
        return last.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= capacity).drop("rn")

    # a block's own keys belong to the start of the next
    first, last = rows.agg(F.min("block"), F.max("block")).first()
    if first is None:
        return rows.select("block", "k", "pos")
    state = cut(top(rows.select((F.col("block") + 1).alias("block"), "k", "pos")))
    reach = 1
    while reach <= last - first:
        full = state.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") >= capacity).select("block")
        needy = rows.sparkSession.range(first + 1, last + 2).toDF("block").join(full, "block", "left_anti").filter(F.col("block") - reach > first)
        if needy.isEmpty():
            break
        older = state.select((F.col("block") + reach).alias("block"), "k", "pos").join(needy, "block", "left_semi")
        state = cut(top(state.unionByName(older)))
        reach *= 2
    return state


def _lru_flags(rows: DataFrame, capacity: int) -> DataFrame:
    """Rows (k, seq, pos, block) with ``kept``: whether the key is among the ``capacity`` keys used last before it."""
    # blocks are numbered without gaps, so that empty stretches of the order cost nothing
    dense = positions(rows.select("block").distinct(), "block").select("block", F.col("pos").alias("dense"))
    rows = cut(rows.join(broadcast_if_small(dense, BROADCAST_BLOCKS), "block").select("k", "seq", "pos", F.col("dense").alias("block")))
    starts = _starts(rows, capacity)

    def replay(block, held_before):
        held: OrderedDict[str, None] = OrderedDict.fromkeys(held_before.sort_values("pos", kind="stable")["k"])
        block = block.sort_values("pos", kind="stable")
        flags = []
        for k in block["k"]:
            flags.append(k in held)
            held.pop(k, None)
            held[k] = None
            if len(held) > capacity:
                held.popitem(last=False)
        return block.assign(kept=flags)[["k", "seq", "pos", "kept"]]

    return rows.groupBy("block").cogroup(starts.select(F.col("block").alias("b"), F.col("k").alias("k"), F.col("pos").alias("pos")).groupBy("b")).applyInPandas(replay, "k string, seq bigint, pos bigint, kept boolean")


def lru_replay(accesses: DataFrame, key: str = "cache_key", order: str = "seq", capacity: int = 1000, block: int = 50_000) -> DataFrame:
    """(key, seq, hit BOOLEAN): an access is a hit iff its key is among the ``capacity`` keys used last before it.

    Blocks of ``block`` consecutive order numbers are replayed in parallel from their true starts.
    """
    pos = F.col(order).cast("bigint")
    rows = accesses.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), pos.alias("seq"), pos.alias("pos"), F.floor(pos / block).cast("bigint").alias("block"))
    return _lru_flags(rows, capacity).select(F.col("k").alias(key), "seq", F.col("kept").alias("hit"))


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, its place (from 0) in the given order over all rows; one number per partition reaches the driver."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    schema = placed.drop("__part").schema.add("pos", LongType())
    names = schema.names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = offsets[batch.column(batch.num_columns - 1)[0].as_py()] if at is None else at
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(range(at, at + batch.num_rows), pa.int64())], names=names)
            at += batch.num_rows

    return placed.mapInArrow(number, schema)


def cache_replay(accesses: DataFrame, key: str = "cache_key", order: tuple[str, str] = ("ts", "seq"), ttl: str = "ttl", default_ttl: int = 3600, capacity: int = 1000, block: int = 50_000, partitions: int | None = None) -> DataFrame:
    """(key, seq, outcome STRING): ``hit``, or a miss because the entry is ``absent`` (never there or evicted) or ``expired``.

    An entry lives from its write until its time to live ends or until ``capacity`` other keys were used after it. An
    expired entry is removed when it is asked for and written again at once, so the cache always holds the keys used last
    and eviction does not depend on expiry: the keys used last decide which accesses find their entry, then the chain of
    misses of each key decides which of these entries still live.
    """
    ts, seq = order
    rows = accesses.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(seq).cast("bigint").alias("seq"), _lives(ttl, default_ttl).alias("life"))
    placed = cut(positions(rows, "t", "seq"))
    kept = _lru_flags(placed.select("k", "seq", "pos", F.floor(F.col("pos") / block).cast("bigint").alias("block")), capacity)
    flagged = placed.join(kept.select("pos", "kept"), "pos").select("k", "t", "seq", "life", "kept")
    done = _ttl_blocks(flagged, partitions)
    outcome = F.when(F.col("hit"), "hit").when(F.col("kept"), "expired").otherwise("absent")
    return done.select(F.col("k").alias(key), "seq", outcome.alias("outcome"))
