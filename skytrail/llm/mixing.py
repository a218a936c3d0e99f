"""Mixing sources to target weights by Pfair scheduling: each block of a source has a release time
and a deadline from the source's weight, and the earliest deadline goes first."""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bucketed_rank, small, stash, table

BLOCK = 16  # documents a block
MAX_SOURCES = 1000  # all that the driver plans with; more sources are an error
PLACE = ["phase", "slot", "position"]
FLATTEN = 0.5  # default targets: the square root of each source's documents


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integers that add up to the period: largest remainders, at least 1 each."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    by_need = sorted(out, key=lambda k: (out[k] - exact[k], k))
    while (off := period - sum(out.values())) != 0:
        for k in by_need if off > 0 else reversed(by_need):
            if off and (off > 0 or out[k] > 1):
                out[k] += 1 if off > 0 else -1
                off += -1 if off > 0 else 1
    return out


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """The least integers in exactly the proportions of the weights.

    Sources of weight 0 come after all others, in equal parts, so they are left out beside these.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    parts = {k: Fraction(w) for k, w in weights.items() if w > 0} or dict.fromkeys(weights, Fraction(1))
    unit = math.lcm(*(w.denominator for w in parts.values()))
    whole = {k: int(w * unit) for k, w in parts.items()}
    least = math.gcd(*whole.values())
    return {k: w // least for k, w in whole.items()}


def pfair(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, array]:
    """The slots of each source in a period of sum(weights) slots, which ends early when a source
    has no block left.

    Block j (from 0) of a source of weight w may start at floor(j * period / w) and must have gone by
    ceil((j + 1) * period / w).  With weights that fill the period, earliest deadline first meets
    every deadline, so no source is ever a whole block before or behind its part.
    """
    period = sum(weights.values())
    coming = [(0, -(-period // w), k, 0) for k, w in weights.items()]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out = {k: array("q") for k in weights}
    t = 0
    while t < period:
        while coming and coming[0][0] <= t:
            _, deadline, k, j = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, k, j))
        _, k, j = heapq.heappop(ready)
        out[k].append(t)
        t += 1
        if j + 1 == blocks[k]:
            break
        if j + 1 < (w := weights[k]):
            heapq.heappush(coming, ((j + 1) * period // w, -(-(j + 2) * period // w), k, j + 1))
    return out


def plan(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[dict]:
    """Phases: when a source has no block left, the others go on at weights in the same proportions.

    Each phase: start (its first slot), length, period, and for each source (first block, blocks in
    the phase, weight, slots in a period).  There are at most as many phases as sources.  weight /
    period is the source's part exactly; with `period` parts are rounded to whole slots of so many.
    Slots are listed up to the phase's end, 8 bytes a block.
    """
    done = dict.fromkeys(blocks, 0)
    out, start = [], 0
    while active := {k: weights[k] for k in sorted(blocks) if done[k] < blocks[k]}:
        whole = whole_weights(active, period) if period else exact_weights(active)
        left = {k: blocks[k] - done[k] for k in whole}
        size, slots = sum(whole.values()), pfair(whole, left)
        length = min(((n - 1) // whole[k]) * size + slots[k][(n - 1) % whole[k]] + 1 for k, n in left.items() if (n - 1) % whole[k] < len(slots[k]))
        sources = {}
        for k, w in whole.items():
            n = length // size * w + bisect_left(slots[k], length % size)
            sources[k] = (done[k], n, w, slots[k])
            done[k] += n
        out.append({"start": start, "length": length, "period": size, "sources": sources})
        start += length
    return out


def source_key(column: str = "source") -> Column:
    """Never null: null sources are a source of their own, apart from any name."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def digests(docs: DataFrame) -> list[Column]:
    """Two hashes of a row's other columns, which tell apart rows of one source and doc_id."""
    others = [c for c in docs.columns if c not in ("source", "doc_id")]
    values = [F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in others]
    return [F.xxhash64(F.lit(k), *values, *[F.col(c).isNull() for c in others]).alias(f"_t{k}") for k in (0, 1)]


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 42, period: int | None = None) -> DataFrame:
    """source, doc_id, phase, block, slot and position (from 0, no gaps) of every row.

    weights: target weights by source; a source without one has the least of them.  Without weights
    they are the square roots of the sources' sizes.  Within a source documents are in hash order.
    In each phase, every source is less than a block off its part at every slot, by the weights as
    they are asked for (rounded only if a period is given); of weight 0 they go last.  No row is left
    out: sources that run out leave, and the others go on.  Rows that repeat a (source, doc_id) have
    a position each, and so have rows of null ids; null sources are one source.
    """
    return _positions(docs, weights, block, seed, period).select("source", "doc_id", "phase", "block", "slot", "position")


def _positions(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 42, period: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    rows = stash(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), *digests(docs)).withColumn("_k", source_key()), "sources")
    sizes = dict(tuple(r) for r in rows.groupBy("_k").count().limit(MAX_SOURCES + 1).collect())
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        targets = {k: n**FLATTEN for k, n in sizes.items()}
    else:
        given = {f"={k}": w for k, w in weights.items()}
        targets = {k: given.get(k, min(given.values())) for k in sizes}
    phases = plan({k: -(-n // block) for k, n in sizes.items()}, targets, period)
    turns, slots, short = [], [], []  # slots: (turn, j, slot) as arrays
    for p, ph in enumerate(phases):
        for k, (first, n, w, at) in ph["sources"].items():
            if n:
                listed = min(n, w)  # a longer turn repeats them
                turns.append((k, p, len(turns), first, first + n, listed, ph["start"], ph["period"] if n > w else 0))
                slots.append((np.full(listed, len(turns) - 1, np.int32), np.arange(listed), np.frombuffer(at, np.int64)[:listed]))
            if n and first + n == -(-sizes[k] // block) and sizes[k] % block:
                slot = ph["start"] + (n - 1) // w * ph["period"] + at[(n - 1) % w]
                short.append((slot, block - sizes[k] % block))
    ranked = bucketed_rank(rows, ["_k"], F.xxhash64(F.coalesce("doc_id", "_t0"), F.lit(seed)), ["doc_id", "_t0", "_t1"], "_rank", sum(sizes.values()))
    ranked = ranked.withColumn("block", F.expr(f"_rank div {block}"))
    # Turns are bounded by MAX_SOURCES; slots are at most one a block, and broadcast only while few.
    turn = F.broadcast(spark.createDataFrame(turns, "_k string, phase int, _turn int, _from long, _to long, _w long, _start long, _period long"))
    columns = [np.concatenate(c) for c in zip(*slots, strict=True)] if slots else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64)]
    slot = small(spark.createDataFrame(pa.table(columns, names=["_turn", "_j", "_slot"])), len(columns[0]))
    got = ranked.join(turn, "_k").filter("block >= _from and block < _to")
    got = got.withColumn("_j", F.expr("(block - _from) % _w")).join(slot, ["_turn", "_j"])
    got = got.withColumn("slot", F.expr("_start + (block - _from) div _w * _period + _slot"))
    gaps = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(n).cast("long").alias("n")) for s, n in sorted(short)])
    before = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + F.when(g["s"] < F.col("slot"), g["n"]).otherwise(F.lit(0).cast("long"))) if short else F.lit(0)
    position = F.col("slot") * block + F.expr(f"_rank % {block}") - before
    return got.select("source", "doc_id", "_k", "_t0", "_t1", "phase", "block", "slot", position.cast("long").alias("position"))


def _placed(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Each row of docs as `row`, beside its _phase, _slot and _position."""
    order = stash(_positions(docs, weights), "order")
    key = ["_k", "_id", "_t0", "_t1"]
    places = order.select("_k", F.col("doc_id").alias("_id"), "_t0", "_t1", *[F.col(c).alias(f"_{c}") for c in PLACE])
    rows = docs.select(F.struct(*docs.columns).alias("row"), source_key().alias("_k"), F.col("doc_id").cast("long").alias("_id"), *digests(docs))

    def on(a: DataFrame, b: DataFrame) -> Column:
        return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in key])

    # Rows that are equal in all columns are one row with several places.
    again = stash(places.groupBy(*key).count().filter("count > 1").select(*key), "repeated")
    n = again.count()
    if not n:
        return rows.join(small(places, order.count()), on(rows, places)).select("row", *[f"_{c}" for c in PLACE])
    once = rows.join(small(again, n), on(rows, again), "left_anti")
    more = rows.join(small(again, n), on(rows, again), "left_semi").dropDuplicates(key)
    return once.union(more).alias("r").join(places.alias("p"), reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key])).select("row", *[f"_{c}" for c in PLACE])


def place(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of docs with their phase, slot and position in the mixture, which hang on the rows alone
    and not on the order in which files are read."""
    return _placed(docs, weights).select("row.*", *[F.col(f"_{c}").alias(c) for c in PLACE])


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of docs, dealt to files and sorted within them in the order of the mixture."""
    return _placed(docs, weights).repartitionByRange("_position").sortWithinPartitions("_position").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents").select("source", "doc_id"))
