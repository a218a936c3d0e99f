"""Sharding by longest processing time: groups that must stay together, largest first, each to the
least-loaded shard of a heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bucketed_rank, small, stash, table

SHARDS = 24


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """LPT over runs of equal items.  classes: (size, how many), largest size first.  Yields (size,
    from, to, shard): the items from..to-1 of that size go to the shard.

    Items of one size go to the least-loaded shard one after another; a run of many is dealt in
    rounds, once all loads are within one item of each other, so its cost depends on the shards alone.
    """
    heap = [(0, s) for s in range(shards)]
    high = 0
    for size, n in classes:
        at = 0
        while at < n:
            if size and high - heap[0][0] < size and n - at >= 2 * shards:
                # Each of the next rounds gives every shard one item.
                rounds = (n - at) // shards - 1
                order = sorted(heap)
                for _, s in order:
                    yield size, at, at + rounds, s
                    at += rounds
                heap = [(load + rounds * size, s) for load, s in order]
                high += rounds * size
                continue
            load, s = heap[0]
            second = min(heap[1:3])[0] if shards > 1 else None
            # As many as keep it the least-loaded one.
            take = min(n - at, max(1, (second - load) // size)) if second is not None and size else n - at
            yield size, at, at + take, s
            at += take
            heapq.heapreplace(heap, (load + take * size, s))
            high = max(high, load + take * size)


def deal(shards: int):
    """Rows (size, how many), largest size first, to one row a size: where its runs end, and their shards.

    The memory is that of the shards and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sizes: list, ends: list, where: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(where, pa.list_(pa.int32()))], ["gsize", "ends", "shards"])

        sizes, ends, where = [], [], []
        for size, _, to, s in schedule((c for b in batches for c in zip(*(x.to_pylist() for x in b.columns), strict=True)), shards):
            if not sizes or sizes[-1] != size:
                if len(sizes) >= 10_000:
                    yield out(sizes, ends, where)
                    sizes, ends, where = [], [], []
                sizes.append(size), ends.append([]), where.append([])
            ends[-1].append(to), where[-1].append(s)
        yield out(sizes, ends, where)

    return run


def shard_by_size(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard.

    size: the UTF-8 bytes of the text plus 8.  Null text counts as empty, and groups with it.
    Repeated rows and rows with null ids each take a slot of their own.  Loads are near equal unless
    one group is larger than a shard's part, for a group isn't split.

    The one task that schedules sees a row for each distinct size of a group, not for each group:
    d distinct sizes need at least d * d / 2 bytes of texts, so there are at most 14 million of them
    in 100 TB, and they pass through in a stream.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.md5(data)).alias("g")), "rows")
    groups = stash(rows.groupBy("g").agg(F.sum("size").alias("gsize")), "groups")
    sizes = groups.groupBy("gsize").agg(F.count("*").alias("n"))
    ordered = sizes.repartition(1).sortWithinPartitions(F.desc("gsize"))
    plan = stash(ordered.mapInArrow(deal(shards), "gsize long, ends array<long>, shards array<int>"), "schedule")
    weight = plan.agg(F.coalesce(F.sum(F.size("ends") * 1.5 + 4), F.lit(0.0))).first()[0]  # in long integers
    ranked = bucketed_rank(groups, ["gsize"], F.xxhash64("g"), ["g"], "rank", groups.count())
    dealt = ranked.join(small(plan, weight), "gsize").select("g", F.expr("shards[size(filter(ends, e -> e <= rank))]").alias("shard"))
    placed = stash(rows.join(dealt, "g").drop("g"), "placed")
    return bucketed_rank(placed, ["shard"], F.xxhash64("doc_id", "text_crc32"), ["doc_id", "text_crc32", "size"], "slot", placed.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_size(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
