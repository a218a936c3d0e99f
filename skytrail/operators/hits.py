"""Where segments meet the triangles of their scene: blocks of both, in the order of space, go to a kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from skytrail.functions import angles
from skytrail.sources.scratch import small, written

TRIANGLES, SEGMENTS = 16384, 1024  # rows of a block
FRONT = 1024  # triangles, about, of the whole mesh that paths meet before they are packed
TILE = 256  # triangles and segments that are compared at a time
SLACK = 1e-6  # boxes are wider by this
BOX = [f"{m}{c}" for m in ("lo", "hi") for c in "xyz"]
CORNERS = [f"{v}{c}" for v in "abc" for c in "xyz"]
ENDS = [f"p{i}{c}" for i in (0, 1) for c in "xyz"]


def exact(p: np.ndarray, d: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Möller-Trumbore of rows: whether the segment from p along the unit d meets the triangle, and how far from p."""

    def cross(u, v):
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    e, f, s, d = (b - a).T, (c - a).T, (p - a).T, d.T
    h, q = cross(d, f), cross(s, e)
    det = dot(e, h)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        u, v, at = dot(s, h) / det, dot(d, q) / det, dot(f, q) / det
        return (abs(det) > 1e-14) & (u >= 0) & (v >= 0) & (u + v <= 1) & (at >= -1e-8) & (at <= length + 1e-8), np.maximum(at, 0.0)


class Block:
    """Segments (n, 6) of several keys (g), and the least distance of a hit so far for each key.

    With `nearest` a segment is searched as far as its key's best hit; else a key is done with its first.
    """

    def __init__(self, ends: np.ndarray, g: np.ndarray, keys: int, nearest: bool) -> None:
        self.p, self.g, self.nearest = ends[:, :3], g, nearest
        step = ends[:, 3:] - self.p
        self.length = np.sqrt(step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1] + step[:, 2] * step[:, 2])
        self.d = step / self.length[:, None]
        self.best = np.full(keys, np.inf)

    def meet(self, tri: np.ndarray) -> None:
        """Compares with triangles (n, 9); the first tiles are small, as they often settle a key."""
        at, size = 0, 16
        while at < len(tri):
            self._tile(tri[at : at + size])
            at, size = at + size, min(2 * size, TILE)

    def _tile(self, tri: np.ndarray) -> None:
        best = self.best[self.g]
        reach = np.minimum(self.length + 1e-8, best)
        tip = self.p + self.d * reach[:, None]
        corners = tri.reshape(-1, 3)
        low, high = corners.min(0), corners.max(0)
        near = ((np.minimum(self.p, tip) - SLACK <= high) & (np.maximum(self.p, tip) + SLACK >= low)).all(1)
        todo = np.flatnonzero(near & (best > 0))
        if not len(todo):
            return
        # Around the tile's middle, so that rounding is small beside its triangles.
        mid = (low + high) / 2
        a, b, c = (tri[:, i : i + 3] - mid for i in (0, 3, 6))
        normal = np.cross(b - a, c - a).T
        plane = np.concatenate([normal, -np.einsum("ij,ji->i", a, normal)[None]])
        for k in range(0, len(todo), TILE):
            i = todo[k : k + TILE]
            i = i[self.best[self.g[i]] > 0]
            p, d = self.p[i] - mid, self.d[i]
            # How far the triangle's plane is: a bound from below that leaves few pairs for the exact test.
            most = max(np.abs(p).max(initial=0.0), np.abs(corners - mid).max())
            error = 1e-12 * most**3 + 1e-15 * max(np.abs(corners).max(), np.abs(self.p[i]).max(initial=0.0)) * most**2
            top, bottom = np.concatenate([p, np.ones((len(p), 1))], axis=1) @ plane, d @ normal
            bound = (np.minimum(self.length[i] + 1e-8, self.best[self.g[i]]) + SLACK)[:, None] * np.abs(bottom)
            r, t = np.nonzero(~(np.abs(top) > bound + error))
            ahead = ~(top[r, t] * np.sign(bottom[r, t]) > SLACK * np.abs(bottom[r, t]) + error)
            r, t = i[r[ahead]], t[ahead]
            ok, at = exact(self.p[r], self.d[r], self.length[r], tri[t, :3], tri[t, 3:6], tri[t, 6:])
            np.minimum.at(self.best, self.g[r[ok]], at[ok] if self.nearest else 0.0)


def numbered(t: pa.Table, key: list[str]) -> tuple[np.ndarray, pa.StructArray]:
    """The distinct keys of a table, and for each row its key's place among them."""
    g = t.select(key).to_pandas().groupby(key, sort=False, dropna=False).ngroup().to_numpy()
    first = pa.array(np.unique(g, return_index=True)[1])
    return g, pa.StructArray.from_arrays([t.column(k).combine_chunks().take(first) for k in key], names=key)


def packed(df: DataFrame, on: list[str], key: list[str], cols: list[str], rows: int, front: dict[tuple, np.ndarray] | None = None) -> DataFrame:
    """Blocks of up to `rows` rows of a scene, in their order within a partition: on, _id, the box, the
    columns as doubles in `_data`, and, with a key, its values in `_keys` and each row's place there in `_g`.

    Segments whose keys meet a triangle of their scene's `front` are left out; those keys come in blocks
    of their own, without rows and box."""
    schema = StructType(df.select(*on).schema.fields).add("_id", "long")
    for c in BOX:
        schema = schema.add(c, "double")
    schema = schema.add("_data", "binary")
    if key:
        schema = schema.add("_g", "binary").add("_keys", ArrayType(StructType(df.select(*key).schema.fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        made = TaskContext.get().partitionId() << 40

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            data = np.column_stack([t.column(c).to_numpy() for c in cols])
            points = data.reshape(-1, 3)
            out = [t.column(c).slice(0, 1).combine_chunks() for c in on] + [pa.array([made])]
            out += [pa.array([float(v)]) for v in (*points.min(0), *points.max(0))] + [pa.array([data.tobytes()], pa.binary())]
            made += 1
            if key:
                g, keys = numbered(t, key)
                out += [pa.array([g.astype(np.int32).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        def met(part: pa.RecordBatch, tri: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            """The segments of keys that do not meet the triangles, and the block of those that do."""
            nonlocal made
            g, keys = numbered(pa.Table.from_batches([part]), key)
            block = Block(np.column_stack([part.column(c).to_numpy() for c in cols]), g, len(keys), nearest=False)
            block.meet(tri)
            done = np.isfinite(block.best)
            keys = keys.take(pa.array(np.flatnonzero(done)))
            out = [part.column(c).slice(0, 1) for c in on] + [pa.array([made])] + [pa.array([None], pa.float64())] * len(BOX)
            out += [pa.array([b""], pa.binary())] * 2 + [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            made += 1
            return part.filter(pa.array(~done[g])), pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            for scene, at in batch.select(on).to_pandas().groupby(on, sort=False).indices.items():
                scene = scene if isinstance(scene, tuple) else (scene,)
                part = batch.take(pa.array(at))
                if front and scene in front:
                    part, done = met(part, front[scene])
                    yield done
                    if not part.num_rows:
                        continue
                held.setdefault(scene, []).append(part)
                if sum(b.num_rows for b in held[scene]) >= rows:
                    t = pa.Table.from_batches(held.pop(scene))
                    for i in range(0, t.num_rows, rows):
                        yield emit(t.slice(i, rows))
            if sum(b.num_rows for parts in held.values() for b in parts) > 16 * rows:
                for parts in held.values():
                    yield emit(pa.Table.from_batches(parts))
                held.clear()
        for parts in held.values():
            yield emit(pa.Table.from_batches(parts))

    return df.select(*on, *[k for k in key if k not in on], *cols).mapInArrow(run, schema)


def searched(key: StructType, nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel over pairs of blocks: the keys that meet a triangle, and the least distance.  Pairs of
    one block of segments that follow one another share what was found.  A block without segments has
    keys that are done, and a block without triangles meets none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, keys = None, None, None

        def result() -> pa.RecordBatch:
            hit = np.flatnonzero(np.isfinite(block.best))
            values = keys.take(pa.array(hit)).flatten()
            return pa.RecordBatch.from_arrays([*values, pa.array(block.best[hit])], names=[*key.names, "distance"])

        for batch in batches:
            ids, data, ends, g = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_tri", "_data", "_g"))
            lists = batch.column(batch.schema.get_field_index("_keys"))
            for i in range(batch.num_rows):
                if ids[i].as_py() != now:
                    if block is not None:
                        yield result()
                    now, keys = ids[i].as_py(), lists[i].values
                    block = Block(np.frombuffer(ends[i].as_buffer()).reshape(-1, 6), np.frombuffer(g[i].as_buffer(), np.int32), len(keys), nearest)
                    if not len(block.p):
                        block.best[:] = 0.0
                if data[i].is_valid:
                    block.meet(np.frombuffer(data[i].as_buffer()).reshape(-1, 9))
        if block is not None:
            yield result()

    return run


def segment_hits(segments: DataFrame, triangles: DataFrame, on: list[str], key: list[str], nearest: bool = True) -> DataFrame:
    """(key, distance): the keys whose segments (p0*, p1*) meet a triangle (a*, b*, c*) of the same scene,
    and how far from p0 the nearest hit of their segments is; without `nearest`, 0.

    Both sides are packed in blocks, triangles by a curve that fills space.  Blocks of a scene are joined
    where their boxes meet, and a kernel goes through a pair tile by tile: boxes first, then the distance
    of each triangle's plane, then Möller-Trumbore.  Blocks of triangles are broadcast if there are few.
    Without `nearest`, paths meet some triangles of all parts of a large mesh first, and those that hit one
    are done; all others meet the whole mesh.
    """
    spark = segments.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # blocks are large rows; it stays set, as the query runs later
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tri = triangles.select(*on, *[F.col(n).cast("double").alias(n) for n in CORNERS]).dropna()
    whole = tri.agg(F.count("*").alias("n"), *[f(c).alias(f"{m}{c}") for c in ("ax", "ay", "az") for m, f in (("lo", F.min), ("hi", F.max))]).first()
    bits = []
    for axis, c in enumerate(("ax", "ay", "az")):
        lo, hi = whole[f"lo{c}"], whole[f"hi{c}"]
        if whole.n and hi > lo:
            q = ((F.col(c) - lo) * (1023 / (hi - lo))).cast("long")
            bits += [F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1)), 3 * b + axis) for b in range(10)]
    front = None
    if not nearest and (whole.n or 0) > TRIANGLES:
        front = {}
        for row in tri.filter(F.rand(0) < FRONT / whole.n).collect():
            front.setdefault(tuple(row[: len(on)]), []).append(row[len(on) :])
        front = {scene: np.array(rows) for scene, rows in front.items()}
    tri = tri.withColumn("_curve", reduce(Column.__add__, bits, F.lit(0).cast("long"))).repartitionByRange(max(1, min(tasks, (whole.n or 0) // TRIANGLES)), *on, "_curve").sortWithinPartitions(*on, "_curve")
    tri = packed(tri, on, [], CORNERS, TRIANGLES).withColumnsRenamed({c: f"_{c}" for c in BOX} | {"_id": "_tid", "_data": "_tri"})

    p0, p1 = ([F.col(f"p{i}{c}") for c in "xyz"] for i in (0, 1))
    seg = segments.select(*on, *[k for k in key if k not in on], *[F.col(c).cast("double").alias(c) for c in ENDS]).withColumn("_len", angles.distance(p0, p1)).filter("_len > 1e-12 and not isnan(_len)")
    # Many tasks share the work, even where there are few blocks.
    seg = packed(seg, on, key, ENDS, SEGMENTS, front).repartition(tasks, "_id")
    meet = reduce(Column.__and__, [(F.col(f"lo{c}") - 2 * SLACK <= F.col(f"_hi{c}")) & (F.col(f"hi{c}") + 2 * SLACK >= F.col(f"_lo{c}")) for c in "xyz"])
    schema = StructType(segments.select(*key).schema.fields)
    if small(tri, whole.n) is not tri:
        same = reduce(Column.__and__, [seg[c] == tri[c] for c in on])
        pairs = seg.join(small(tri, whole.n), same & meet, "left" if front else "inner")
    else:
        seg, tri = written(seg, "segments"), written(tri, "triangles")  # their ids hold for one computation
        boxes = seg.select(*on, "_id", *BOX).join(tri.select(*on, "_tid", *[f"_{c}" for c in BOX]), on).filter(meet).select("_id", "_tid")
        pairs = boxes.join(seg.select("_id", "_data", "_g", "_keys"), "_id").join(tri.select("_tid", "_tri"), "_tid")
        if front:
            pairs = pairs.drop("_tid").unionByName(seg.filter(F.length("_data") == 0).select("_id", "_data", "_g", "_keys", F.lit(None).cast("binary").alias("_tri")))
    hits = pairs.select("_id", "_tri", "_data", "_g", "_keys").mapInArrow(searched(schema, nearest), StructType(schema.fields).add("distance", "double"))
    return hits.groupBy(*key).agg(F.min("distance").alias("distance"))
