"""Exact n-gram Jaccard join by skipping over set relations.

1. Copies: documents of one shingle set are one node.
2. Hubs: a set that is highly similar to the hub of a min-hash group, by an exact check, takes over
   the hub's answers: it is in the hub's component, and only what lies outside is still asked for.
3. Index: each set's rarest shingles (a prefix that no set within the threshold can miss) make
   inverted lists, sorted into blocks by set size and position.  A whole block is skipped if its
   sizes, its positions or its component can add nothing.
4. Pairs that remain, each over two components, must pass a bound on their symmetric difference (the
   parity of the shingles in each of some slots), and are then checked exactly on whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bounded_batches, components, small, stash, table
from skytrail.llm.shingles import mix, shingle_sets

WORDS, NUM, DEN = 4, 85, 100
KEYS, KEYS_EQUAL, GROUPED = 6, 4, 3
_PERM = np.random.default_rng(7).integers(1, 2**63, KEYS, dtype=np.uint64) | np.uint64(1)
#: The sketch that orders shingles by frequency has a one-byte counter for each 64 bytes of input, in
#: a power of two up to this one; it is broadcast.
SKETCH_BITS = 24
#: Longer lists are cut into blocks that are paired in tasks of their own.
LIST_ROWS = 100_000
#: The entries of 56 bytes are dealt to as many tasks as this makes of them.
ENTRIES_PER_TASK = 2_000_000


def _minima(h: np.ndarray, starts: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = h * factor
    return np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def parities(h: np.ndarray) -> bytes:
    """Whether each slot has an odd number of the hashes; at least 0.6 slots a hash, a power of two."""
    size = max(64, 1 << int(0.6 * len(h) - 1e-9).bit_length())
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the longer map is folded onto the shorter one."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b).sum())


PROFILE = ["id", "n", "fp1", "fp2", "keys", "slots", "counts"]


def profiles(words: int, sketch_bits: int):
    """A row a document: id, n, fp1, fp2, min-hash keys and parities; and a row a task: its shingle
    counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << sketch_bits, np.uint8), [], 0

        def count() -> None:
            if waiting:
                at, n = np.unique_counts(np.concatenate(waiting))
                counts[at] = np.minimum(counts[at] + n, 255)
                waiting.clear()

        for b in batches:
            for lo, hi, h, bounds in shingle_sets(b.column(1), words):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                starts = bounds[full]
                cols = np.zeros((2 + KEYS, hi - lo), np.uint64)
                if len(full):
                    cols[0, full] = np.add.reduceat(h, starts)
                    cols[1, full] = np.add.reduceat(mix(h), starts)
                    for j in range(KEYS):
                        cols[2 + j, full] = _minima(h, starts, _PERM[j])
                    waiting.append((h >> np.uint64(64 - sketch_bits)).astype(np.int64))
                    size += len(h)
                    if size > 2_000_000:
                        count()
                        size = 0
                slots = [parities(h[x:y]) if y > x else None for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                keys = pa.FixedSizeListArray.from_arrays(pa.array(_signed(np.ascontiguousarray(cols[2:].T).ravel())), KEYS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n), pa.array(_signed(cols[0])), pa.array(_signed(cols[1])), keys, pa.array(slots, pa.binary()), pa.nulls(hi - lo, pa.binary())], PROFILE)
        count()
        if counts.any():
            packed = zlib.compress(counts.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), *(pa.array([0]) for _ in range(2)), pa.array([None], pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], PROFILE)

    return run


def add_counts(sketch_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(batches, sketch_bits)

    return run


def _added(batches: Iterator[pa.RecordBatch], sketch_bits: int) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            c = zlib.decompress(x)
            c = np.frombuffer(c, np.uint32 if len(c) == 4 << sketch_bits else np.uint8)
            total = c.astype(np.uint32) if total is None else total + np.minimum(c, 2**32 - 1 - total)
    if total is not None:
        packed = zlib.compress(total.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["counts"])


def sketch_size(docs: DataFrame, most: int) -> int:
    """Bits of a sketch with a counter for each 64 bytes of the input files, as the plan knows them."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(min(16, most), min(most, (size // 64).bit_length()))


def frequency_levels(rows: DataFrame, tasks: int, sketch_bits: int) -> bytes:
    """A byte a counter: 0 for ordinary shingles, else the logarithm of how far above the mean it is.

    Counts cover all documents.  Partial counts are added up in a tree, 32 at a time, so that one
    array of fixed size is all that comes to the driver.
    """
    while True:
        tasks = -(-tasks // 32)
        rows = rows.repartition(tasks).mapInArrow(add_counts(sketch_bits), "counts binary")
        if tasks == 1:
            break
        rows = stash(rows, "counts")
    got = rows.collect()
    if not got:
        return b""
    total = np.frombuffer(zlib.decompress(got[0][0]), np.uint32).astype(np.float32)
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / max(float(total.mean()), 1) / 1.2)) + 1).astype(np.uint8).tobytes()


def prefixes(words: int, num: int, den: int, sketch_bits: int, levels):
    """(id, n, p0, p1, toks): the shingles of each set that come first by (frequency level, hash), as
    many as needed for two sets within the threshold to share one; and parities of 128 slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(b.column(1), words):
                n = np.diff(bounds)
                lv = level[(h >> np.uint64(64 - sketch_bits)).astype(np.int64)] if len(h) else np.zeros(0, np.uint8)
                parts, sizes = [], np.zeros(hi - lo, np.int64)
                odd = np.zeros((2, hi - lo), np.uint64)
                if len(h):
                    bit, upper = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) != 0
                    for k in (0, 1):
                        odd[k, n > 0] = np.bitwise_xor.reduceat(np.where(upper == bool(k), bit, np.uint64(0)), bounds[:-1][n > 0])
                for i in np.flatnonzero(n):
                    s, e = bounds[i], bounds[i + 1]
                    p = int(n[i] - -(-num * n[i] // den) + 1)
                    at = np.flatnonzero(lv[s:e] == 0)
                    if len(at) < p:
                        at = np.argsort(lv[s:e], kind="stable")
                    parts.append(h[s:e][at[:p]])
                    sizes[i] = p
                flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                toks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(_signed(flat)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n), pa.array(_signed(odd[0])), pa.array(_signed(odd[1])), toks], ["id", "n", "p0", "p1", "toks"])

    return run


def block_pairs(cols: list[np.ndarray], num: int, den: int, left: int | None = None) -> Iterator[np.ndarray]:
    """Candidate pairs (2, n) of ids, over lists sorted by (tok, n, pos).  left: only pairs of one of
    the first `left` entries with one of the rest.

    Every entry has a pointer into its list.  Blocks are runs of one size; an entry is done when sizes
    are too far apart or its own position leaves too few shingles, and jumps over the rest of a block
    when the block's positions (they rise) or its single component rule the rest out.  A pair that is
    left must also pass the bound that the entries' parities give.
    """
    tok, n, pos, comp, ids, *odd = cols
    odd = [x.view(np.uint64) for x in odd]
    size = len(tok)
    new = np.ones(size + 1, bool)
    new[1:-1] = (tok[1:] != tok[:-1]) | (n[1:] != n[:-1])
    starts = np.flatnonzero(new)
    block = np.cumsum(new[:-1]) - 1
    ends = starts[1:][block]  # where the block of each entry ends
    only = np.minimum.reduceat(comp, starts[:-1]) == np.maximum.reduceat(comp, starts[:-1]) if size else new[:0]
    i = np.arange(size if left is None else left)
    j = i + 1 if left is None else np.full(left, left)
    while len(i):
        keep = j < size
        i, j = i[keep], j[keep]
        ni, nj = n[i], n[j]
        need = -(-num * (ni + nj) // (num + den))
        keep = (tok[i] == tok[j]) & (den * ni >= num * nj) & (pos[i] <= ni - need)
        i, j, nj, need = i[keep], j[keep], nj[keep], need[keep]
        late = pos[j] > nj - need
        same = only[block[j]] & (comp[i] == comp[j])
        hit = np.flatnonzero(~late & (comp[i] != comp[j]))
        apart = sum(np.bitwise_count(x[i[hit]] ^ x[j[hit]]).astype(np.int64) for x in odd)
        hit = hit[apart * (den + num) <= (n[i[hit]] + nj[hit]) * (den - num)]
        if len(hit):
            a, b = ids[i[hit]], ids[j[hit]]
            yield np.stack((np.minimum(a, b), np.maximum(a, b)))
        j = np.where(late | same, ends[j], j + 1)


ENTRY = ["tok", "n", "pos", "comp", "id", "p0", "p1"]
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tok", pa.int64()), ("seq", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("block", pa.binary())])
FOUND_DDL = "a long, b long, tok long, seq long, lo long, hi long, block binary"


def _emit(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs, distinct among each half a million."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        p = np.unique(np.concatenate(parts, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), *(pa.nulls(p.shape[1], f.type) for f in list(FOUND)[2:])], schema=FOUND)

    parts, size = [], 0
    for p in pairs:
        parts.append(p)
        size += p.shape[1]
        if size > 500_000:
            merged = np.unique(np.concatenate(parts, axis=1), axis=1)
            parts, size = [merged], merged.shape[1]
            if size > 250_000:
                yield out(parts)
                parts, size = [], 0
    if parts:
        yield out(parts)


def list_pairs(num: int, den: int, list_rows: int):
    """Entries sorted by (tok, n, pos) become candidate pairs; lists of over list_rows entries become
    blocks instead, for block_join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ENTRY)
        long_tok, seq = None, 0

        def cut(cols: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal seq
            row = [None, None, int(cols[0][0]), seq, int(cols[1][0]), int(cols[1][-1]), np.stack(cols).tobytes()]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FOUND, strict=True)], schema=FOUND)

        for b in batches:
            held = [np.concatenate((x, c.to_numpy(zero_copy_only=False))) for x, c in zip(held, b.columns, strict=True)]
            tok = held[0]
            if long_tok is not None:
                stop = int(np.searchsorted(tok != long_tok, True)) if (tok != long_tok).any() else len(tok)
                whole = stop < len(tok)
                if whole or stop >= list_rows:
                    if stop:
                        yield cut([x[:stop] for x in held])
                    held = [x[stop:] for x in held]
                    tok = held[0]
                    if whole:
                        long_tok, seq = None, 0
                if long_tok is not None:
                    continue
            if not len(tok) or len(tok) < list_rows:
                continue
            last = len(tok) - int(np.argmax(tok[::-1] != tok[-1])) if tok[0] != tok[-1] else 0
            if last:
                yield from _emit(block_pairs([x[:last] for x in held], num, den))
                held = [x[last:] for x in held]
            if len(held[0]) >= list_rows:
                long_tok, seq = int(held[0][0]), 0
                yield cut(held)
                held = [x[:0] for x in held]
        if len(held[0]):
            if long_tok is not None and held[0][0] == long_tok:
                stop = int(np.sum(held[0] == long_tok))
                yield cut([x[:stop] for x in held])
                held = [x[stop:] for x in held]
            yield from _emit(block_pairs(held, num, den))

    return run


def block_join(num: int, den: int):
    """Pairs of written blocks (x, y, same) of one list become candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, same in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = (np.frombuffer(v, np.int64).reshape(len(ENTRY), -1) for v in (x, y))
                cols = list(x) if same else list(np.concatenate((x, y), axis=1))
                yield from _emit(block_pairs(cols, num, den, None if same else x.shape[1]))

    return run


def token_rows(words: int):
    """(id, text) to (id, toks): the sorted distinct hashes of the whole set, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(b.column(1), words):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([h[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["id", "toks"])

    return run


def linked(num: int, den: int):
    """Keeps the pairs (a, b, ta, tb) whose sets are within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return run


def possible(num: int, den: int):
    """Keeps the pairs (a, b, na, nb, sa, sb) that the parities of their sets do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, na, nb, sa, sb = (c.to_pylist() for c in b.columns)
            keep = [differ(x, y) * (den + num) <= (m + n) * (den - num) for m, n, x, y in zip(na, nb, sa, sb, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return run


def verified(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, repeated: bool, words: int, num: int, den: int) -> DataFrame:
    """The written pairs (a, b) whose whole sets are within the threshold.  Whole sets are made again
    and shuffled only for pairs that parities do not rule out."""
    slots = nodes.select("id", "n", "slots")
    both = pairs.join(slots.toDF("a", "na", "sa"), "a").join(slots.toDF("b", "nb", "sb"), "b")
    pairs = stash(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(possible(num, den), "a long, b long"), "possible")
    ids = stash(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"), "ids")
    some = texts.join(small(ids, ids.count()), "id", "left_semi").select("id", "text")
    some = some.dropDuplicates(["id"]) if repeated else some
    toks = stash(some.mapInArrow(token_rows(words), "id long, toks binary"), "toks")
    joined = pairs.join(toks.toDF("a", "ta"), "a").join(toks.toDF("b", "tb"), "b")
    return stash(joined.select("a", "b", "ta", "tb").mapInArrow(linked(num, den), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, list_rows: int = LIST_ROWS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of documents whose sets of
    word shingles have den * |A & B| >= num * |A | B|; the id is the smallest doc_id within.

    Empty and null texts have no shingles and link with nothing; shorter texts than a shingle are
    one shingle.  Documents of equal sets link.  doc_id tells documents apart: rows that repeat one
    repeat its result; rows with a null id have the component of documents of an equal set, else null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sketch_bits = sketch_size(texts, sketch_bits)
    base = stash(texts.mapInArrow(profiles(words, sketch_bits), "id long, n long, fp1 long, fp2 long, keys array<long>, slots binary, counts binary"), "profiles")
    partial = base.filter("counts is not null").select("counts")
    levels = spark.sparkContext.broadcast(frequency_levels(partial, max(1, partial.count()), sketch_bits))
    base = base.filter("counts is null")

    copies = base.filter("n > 0 and id is not null").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").drop("last")
    copies = stash(copies, "copies")
    sets = base.join(small(copies, copies.count()), ["fp1", "fp2", "n"], "left")
    leads = (F.col("n") > 0) & F.col("id").isNotNull() & F.coalesce(F.col("rep") == F.col("id"), F.lit(True))
    sets = stash(sets.select("id", "n", F.coalesce("rep", "id").alias("rep"), *[F.when(leads, F.col(c)).alias(c) for c in ("keys", "slots")]), "sets")
    nodes = sets.filter("keys is not null")
    repeated = not nodes.groupBy("id").count().filter("count > 1").isEmpty()
    nodes = nodes.dropDuplicates(["id"]) if repeated else nodes

    # Hubs: the smallest id of each min-hash group; only sets that agree with it in most keys.
    grouped = nodes.select("id", "n", "keys", F.posexplode(F.slice("keys", 1, GROUPED)).alias("slot", "key"))
    hubs = grouped.groupBy("slot", "key").agg(F.min(F.struct("id", "n", "keys")).alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    near = grouped.join(hubs, ["slot", "key"]).filter(F.col("id") != F.col("hub.id"))
    near = near.filter((den * F.least("n", "hub.n") >= num * F.greatest("n", "hub.n")) & (F.aggregate(F.zip_with("keys", "hub.keys", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= KEYS_EQUAL))
    star = stash(near.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct(), "star")
    first = verified(texts, star, nodes, repeated, words, num, den)
    joined = stash(components(first), "hubs")

    part = nodes.select("id").join(small(joined, joined.count()), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    part = stash(part, "part")
    index = texts.mapInArrow(prefixes(words, num, den, sketch_bits, levels), "id long, n long, p0 long, p1 long, toks array<long>").filter("n > 0")
    index = index.join(small(part, part.count()), "id").select("id", "n", "comp", "p0", "p1", F.posexplode("toks").alias("pos", "tok"))
    expected = nodes.agg(F.sum(F.ceil(F.col("n") * (den - num) / den) + 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // ENTRIES_PER_TASK)
    entries = index.withColumn("pos", F.col("pos").cast("long")).select(*ENTRY).repartition(tasks, "tok").sortWithinPartitions("tok", "n", "pos", "id")
    found = stash(entries.mapInArrow(list_pairs(num, den, list_rows), FOUND_DDL), "found")
    x, y = (found.filter("block is not null").select("tok", *(F.col(c).alias(f"{s}_{c}") for c in ("seq", "lo", "hi", "block"))) for s in "xy")
    far = x.join(y, "tok").filter(f"x_seq <= y_seq and {den} * x_hi >= {num} * y_lo").select("x_block", "y_block", F.expr("x_seq = y_seq").alias("same"))
    spread = far.repartition(F.xxhash64("x_block", "y_block")).mapInArrow(block_join(num, den), FOUND_DDL)
    pairs = stash(found.filter("block is null").select("a", "b").union(spread.select("a", "b")).distinct(), "pairs")
    second = verified(texts, pairs, nodes, repeated, words, num, den)
    final = stash(components(first.union(second)).toDF("rep", "comp"), "components")
    out = sets.join(small(final, final.count()), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, that with the smallest doc_id; the columns of docs.

    Rows that repeat the doc_id that stays, all stay; rows of null doc_id stay, as nothing orders them,
    and so do documents without words, which are near to nothing.
    """
    found = jaccard_components(docs.select("doc_id", "text"), words, num, den)
    gone = stash(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
         else list_distinct(list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[(i + 1)::int:(i + 4)::int], ' '))) end sh from w),
e as (select doc_id, len(sh) n, unnest(sh) x from s),
p as (
  select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
r as (select doc_id id, doc_id c from s union select l.b, r.c from r join l on l.a = r.id)
select doc_id, len(sh) n_shingles, (select min(c) from r where r.id = doc_id) component_id from s
"""
