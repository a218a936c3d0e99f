"""Line dedup: a sharded minimal perfect hash over the distinct hashes of repeated lines indexes compact
arrays of fingerprints, counts and keepers; documents probe the arrays, lines are never joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bounded_batches, small, stash, table

MIN_POINTS = 10
WHITE = b" \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct keys of two uint64 words: levels of bit arrays, about 3 bits a key.

    At each level a key sets the bit it falls on if no other key does; the rest goes on to the next
    level.  A key's index is the rank of its bit.
    """

    GAMMA = 1.5

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.words = words
        self.base = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @staticmethod
    def bit(h: np.ndarray, f: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(h ^ mix(f, 2 * level + 2), 2 * level + 1) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            n = int(np.ceil(max(64, cls.GAMMA * len(h)) / 64)) * 64
            at = cls.bit(h, f, len(levels), n)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            h, f = h[~alone[at]], f[~alone[at]]
        return cls(levels)

    def index(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for some keys that are not in the set (others get any index)."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level, words in enumerate(self.levels):
            if not len(todo):
                break
            at = self.bit(h[todo], f[todo], level, len(words) * 64)
            word = words[at >> 6]
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            where = self.base[level] + (at[hit] >> 6)
            out[todo[hit]] = self.rank[where] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + self.words.tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        words = np.frombuffer(data, np.uint64, -1, 8 + 8 * n) if n else np.zeros(0, np.uint64)
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if n else [])


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # bytes.lower() changes A-Z only


def line_hash(key: bytes) -> bytes | None:
    """128-bit hash of a key that has enough code points."""
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode()) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


OCCURRENCE = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("id", pa.int64()), ("t", pa.binary()), ("line", pa.int32())])


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, t) to (h, f, id, t, line) of every line with a key: two words of its hash, and the
    digest t of the whole text, which tells apart texts under one id."""
    for batch in batches:
        hashes, sizes, at = [], [], []
        for text in batch.column(1):
            buf = text.as_buffer() if text.is_valid else None
            before = len(at)
            if buf:
                for i, line in enumerate(buf.to_pybytes().split(b"\n")):
                    if (h := line_hash(line_key(line))) is not None:
                        hashes.append(h), at.append(i)
            sizes.append(len(at) - before)
        words = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        ids = batch.column(0).take(rows)
        cols = [pa.array(words[:, 0]), pa.array(words[:, 1]), ids, batch.column(2).take(rows), pa.array(at, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, schema=OCCURRENCE)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return zip(edges[:-1], edges[1:], strict=True) if len(values) else iter(())


INDEX = {"mph": "binary", "fps": "binary", "counts": "binary", "keepers": "binary"}
SHARD = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in INDEX)])


def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, h, f, n, keeper) sorted by shard become one index row a shard."""

    def row(shard: int, parts: list[tuple]) -> pa.RecordBatch:
        h, f, n, keep = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, f = h.view(np.uint64), f.view(np.uint64)
        mph = PerfectHash.build(h, f)
        order = mph.index(h, f)
        arrays = []
        for x in (f, np.minimum(n, 2**32 - 1).astype(np.uint32), keep):
            a = np.empty_like(x)
            a[order] = x
            arrays.append(a.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (mph.dump(), *arrays))], schema=SHARD)

    now, parts = None, []
    for b in batches:
        shard, *cols = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for s, e in runs(shard):
            if now is not None and shard[s] != now:
                yield row(now, parts)
                parts = []
            now = int(shard[s])
            parts.append(tuple(c[s:e] for c in cols))
    if parts:
        yield row(now, parts)


def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (shard, salt, kind): an index row, then the occurrences that probe its arrays.

    A line that only one document holds is not in the set: it has no index, or another's fingerprint.
    """
    mph = fps = counts = keepers = None
    for b in batches:
        kind = b.column("kind").to_numpy()
        h, f, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "f", "id"))
        out = []
        for s, e in runs(np.cumsum(kind == 0) * 2 + (kind != 0)):
            if kind[s] == 0:
                mph = PerfectHash.load(b.column("mph")[s].as_py())
                fps, counts, keepers = (np.frombuffer(b.column(c)[s].as_py(), t) for c, t in (("fps", np.uint64), ("counts", np.uint32), ("keepers", np.int64)))
                continue
            words = f[s:e].astype(np.int64).view(np.uint64)
            at = mph.index(h[s:e].astype(np.int64).view(np.uint64), words)
            known = np.flatnonzero(at >= 0)
            known = known[fps[at[known]] == words[known]]
            out.append(known[(counts[at[known]] >= 2) & (keepers[at[known]] != ids[s:e][known])] + s)
        drop = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([b.column(c).take(drop) for c in ("id", "t", "line")], ["id", "t", "line"])


def shard_of(bits: int) -> F.Column:
    return F.shiftrightunsigned("h", 64 - bits).cast("int")


def build_index(occ: DataFrame, lines_per_shard: int = 1 << 13, lines_per_task: int = 200_000, rows_per_probe: int = 4_000_000) -> tuple[DataFrame, DataFrame, int, int]:
    """The written index of the lines that at least two documents hold, one row a shard: (shard, mph,
    fps, counts, keepers); (shard, salts), how many tasks probe each shard; the number of shards as
    bits; and how many tasks to deal them to."""
    lines = stash(occ.groupBy("h", "f").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n")), "lines")
    shared = lines.filter("keeper < last")
    n = lines.count()
    bits = max(2, (shared.count() // lines_per_shard).bit_length())
    tasks = max(int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // lines_per_task)
    rows = shared.select(shard_of(bits).alias("shard"), "h", "f", "n", "keeper").repartition(tasks, "shard").sortWithinPartitions("shard")
    index = stash(rows.mapInArrow(build_shards, ", ".join(["shard int", *(f"{c} {t}" for c, t in INDEX.items())])), "index")
    # A shard that hot lines make large is probed by several tasks, each with the shard's arrays.
    asked = lines.groupBy(shard_of(bits).alias("shard")).agg(F.ceil(F.sum("n") / rows_per_probe).cast("int").alias("salts"))
    return index, stash(asked, "asked"), bits, tasks


def keyed(docs: DataFrame) -> DataFrame:
    """row (the other columns, as one struct, so that they may have any names), text, id and t, the
    digest of the whole text; (id, t) is what drops are joined by."""
    text = F.col("text").cast("string")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), digest.alias("t"))


def dropped_lines(docs: DataFrame, rows_per_probe: int = 4_000_000) -> DataFrame:
    """(id, t, drops): the line numbers that each document loses."""
    bounded_batches(docs.sparkSession)
    occ = stash(keyed(docs).select("id", "text", "t").mapInArrow(occurrences, "h long, f long, id long, t binary, line int"), "occ")
    index, asked, bits, tasks = build_index(occ, rows_per_probe=rows_per_probe)
    salts = small(index.select("shard").join(asked, "shard"), 1 << bits)  # one row a shard
    asks = occ.withColumn("shard", shard_of(bits)).join(salts, "shard")
    key = F.pmod(F.xxhash64("id", "t"), F.col("salts")).cast("int").alias("salt")
    asks = asks.select("shard", key, F.lit(1).alias("kind"), "h", "f", "id", "t", "line", *(F.lit(None).cast(t).alias(c) for c, t in INDEX.items()))
    blank = [F.lit(v).cast(t).alias(c) for c, t, v in (("h", "long", 0), ("f", "long", 0), ("id", "long", 0), ("t", "binary", None), ("line", "int", 0))]
    shards = index.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *blank, *INDEX)
    both = shards.union(asks).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = both.mapInArrow(probe, "id long, t binary, line int")
    return found.groupBy("id", "t").agg(F.collect_set("line").alias("drops"))


def apply_drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, drops) to (row, kept text, n_lines, n_dropped)."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            gone = set(drops or ())
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its kept lines: the columns of docs, then _n_lines and _n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at
    least ten code points that at least two documents hold stay only in the smallest doc_id.
    Null or empty text: one empty line, kept as it is.  Rows of one doc_id are one document, so that
    what only they hold stays in each of them; so are all rows of null doc_id, which sorts after all
    others.  Other columns pass unchanged, whatever their names.
    """
    drops = stash(dropped_lines(docs), "drops")
    weight = drops.agg(F.coalesce(F.sum(F.size("drops") + 4), F.lit(0))).first()[0]  # in long integers
    joined = keyed(docs).join(small(drops, weight), ["id", "t"], "left").select("row", "text", "drops")
    out = joined.mapInArrow(apply_drops, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long")
    kept = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*kept, F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, coalesce(text, '') t, unnest(string_split(coalesce(text, ''), chr(10))) line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (
  select doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
g as (
  select k, min(doc_id) keeper from k where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
m as (
  select k.doc_id, k.i, k.line, g.keeper is not null and g.keeper <> k.doc_id gone from k left join g using (k))
select doc_id, count(*) n_lines, sum(gone::int)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from m group by doc_id
"""
