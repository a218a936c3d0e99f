import zlib

import numpy as np
from pyspark.sql import functions as F

from skytrail.llm import line_dedup


def brute(rows):
    holders = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len((t or "").split("\n")), "\n".join(kept)))
    return sorted(out)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 1000, 50_000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        f = rng.integers(0, 2**64, len(h), dtype=np.uint64)
        h[1::7] = h[:1].sum()  # keys that differ in their second word alone
        m = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(h, f).dump())
        assert sorted(m.index(h, f).tolist()) == list(range(len(h)))
        assert len(m.words) * 64 <= max(640, 5 * n)


def test_against_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = line_dedup.line_dedup(documents)
    assert got.columns == [*documents.columns, "_n_lines", "_n_dropped"]
    assert sorted((r.doc_id, r._n_lines, r.text) for r in got.collect()) == brute(rows)


def test_probes_of_a_hot_shard_are_salted(documents):
    a = line_dedup.dropped_lines(documents, rows_per_probe=50).collect()
    b = line_dedup.dropped_lines(documents).collect()
    clean = lambda rows: sorted((r.id, r.t, sorted(r.drops)) for r in rows)
    assert clean(a) == clean(b) != []


def test_odd_rows(odd, none):
    rows = line_dedup.line_dedup(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert got[1]._n_dropped == 0 and got[2]._n_dropped == 2 and got[2].text == ""
    assert got[None]._n_dropped == 2 and got[9]._n_dropped == 1 and got[9].text.endswith("end\n")
    assert (got[3].text, got[3]._n_lines) == (None, 1) and (got[4].text, got[4]._n_lines) == ("", 1)
    assert got[2].h == "k" and got[2].id == 0
    assert line_dedup.line_dedup(none).collect() == []


def test_texts_of_equal_crc_under_one_id(spark):
    shared = "a shared line of text"
    a, b = f"{shared}\nrow 108145", "unique first line number 15843\nsecond"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    rows = [(1, shared), (5, a), (5, b), (None, a), (None, b)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (0, "second"), (1, shared), (5, "row 108145"), (5, b)]


def test_many_null_ids(spark):
    """Texts under null ids are told apart: each loses its first line alone, which the document 0 holds."""
    rows = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("one line that is shared\nbut line %d is its own", "id").alias("text"))
    first = spark.createDataFrame([(0, "one line that is shared")], "doc_id long, text string")
    got = line_dedup.line_dedup(first.union(rows))
    assert got.filter("doc_id is null and _n_dropped = 1 and text like 'but line % is its own'").select("text").distinct().count() == 200_000
    assert got.filter("doc_id = 0 and _n_dropped = 0").count() == 1


def test_index_holds_repeated_lines_alone(spark, documents):
    occ = line_dedup.keyed(documents).select("id", "text", "t").mapInArrow(line_dedup.occurrences, "h long, f long, id long, t binary, line int")
    index = line_dedup.build_index(occ)[0].collect()
    held = occ.groupBy("h", "f").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a < b").collect()
    assert sum(len(r.fps) // 8 for r in index) == len(held) > 0
    assert sorted(x for r in index for x in np.frombuffer(r.counts, np.uint32)) == sorted(r.n for r in held)
