import re
from collections import Counter

from pyspark.sql import functions as F

from skytrail.llm import quality_rules as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(documents, odd, none):
    for df in (documents, odd):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        rows = q.counts(df.select("doc_id", "text")).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.doc_id, r.text) in texts and tuple(r[c] for c in q.BASE) == brute(r.text)
    assert q.counts(none).collect() == []


def labelled(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in q.BASE + q.EXTRA) + ", bad int")


def test_learns_a_conjunction(spark):
    """Bad: many symbols and many bangs; either alone is fine."""
    rows = []
    for i in range(1200):
        symbols, bangs = i % 4 in (0, 1), i % 4 in (0, 2)
        rows.append((100 + i % 7, 500, 60 + i % 5 if symbols else i % 3, 0, 0, 50 + i % 4 if bangs else 0, 10, 80, int(symbols and bangs)))
    rules = q.learn(labelled(spark, rows))
    assert len(rules) == 1 and {c.feature for c in rules[0].conditions} == {"symbols", "bangs"}
    assert rules[0].bad == rules[0].all == 300


def test_more_than_eight_kinds(spark):
    """Twelve kinds of junk between good ones, each told apart by its share of bangs: all are covered."""
    kinds = 12
    rows = [(100, 500 + i % 61, 0, 0, 0, 4 * (i % (2 * kinds)), 10, 80, i % 2) for i in range(2 * kinds * 122)]
    df = labelled(spark, rows)
    rules = q.learn(df)
    assert len(rules) > 8
    got = {(r.bad, r.rejected): r["count"] for r in df.withColumn("rejected", q.verdict(rules).isNotNull()).groupBy("bad", "rejected").count().collect()}
    assert got == {(0, False): kinds * 122, (1, True): kinds * 122}


def test_no_rule_from_noise_or_one_label(spark):
    rows = [(100 + i % 50, 500 + i % 90, i % 11, 0, 0, i % 5, i % 30, 80, i * 7919 % 13 % 2) for i in range(600)]
    assert all(q.purity(r.bad, r.all) >= q.MIN_PURITY for r in q.learn(labelled(spark, rows)))
    assert q.learn(labelled(spark, [(*r[:-1], 0) for r in rows])) == []
    assert q.learn(labelled(spark, [])) == []


def test_verdicts_are_ordered(spark):
    rules = [q.Rule((q.Condition("symbols", True, 0.5),), 1, 1), q.Rule((q.Condition("words", False, 100.0),), 1, 1)]
    df = labelled(spark, [(50, 100, 90, 0, 0, 0, 0, 0, 0), (50, 100, 0, 0, 0, 0, 0, 0, 0), (500, 100, 0, 0, 0, 0, 0, 0, 0)])
    assert [r[0] for r in df.select(q.verdict(rules)).collect()] == [1, 2, None]
    assert df.select(q.verdict([])).first()[0] is None


def test_held_out(spark):
    """Rules from half of the labels, on the other half: bad ones are found, good ones are left alone."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").filter("doc_id % 4 < 2")
    out, _ = q.judge(q.counts(docs).drop("text"), labels.filter("doc_id % 4 = 0"))
    held = out.join(labels, "doc_id").filter("doc_id % 4 = 1 and not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.01 * got[(1, True)]
    assert got.get((0, True), 0) <= 0.1 * (got.get((0, True), 0) + got[(0, False)])


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 0), (3, None), (99, 0)], "doc_id long, quality int")
    kept = q.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "9", "None"]
    assert q.keep_good(none, labels).collect() == []
    assert kept.filter(F.col("h") != "k").count() == 0


def test_columns_of_clashing_names(spark):
    rows = [(1, "one two three", "w", "t", [1], 9)]
    got = q.counts(spark.createDataFrame(rows, "doc_id long, text string, _w string, _t string, _h array<int>, n_words int")).first()
    assert (got.doc_id, got.text, got._w, got._t, got._h, got.n_words) == (1, "one two three", "w", "t", [1], 3)
