from fractions import Fraction

import pytest

from skytrail.llm import mixing


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 5, "c": 1000}, {"a": 37, "b": 41}, {"x": 3}, {f"s{i}": i * 7 + 1 for i in range(30)}])
def test_no_source_is_a_block_off(sizes):
    seen = dict.fromkeys(sizes, 0)
    for phase in mixing.plan(sizes, {k: n**0.5 for k, n in sizes.items()}, 100):
        order = [None] * phase["length"]
        for k, (first, n, w, at) in phase["sources"].items():
            assert first == seen[k]
            seen[k] += n
            for j in range(n):
                slot = j // w * phase["period"] + at[j % w]
                assert order[slot] is None
                order[slot] = k
        counts = dict.fromkeys(phase["sources"], 0)
        for i, k in enumerate(order):
            counts[k] += 1
            assert all(abs(counts[x] - (i + 1) * phase["sources"][x][2] / phase["period"]) < 1 for x in counts)
    assert seen == sizes


@pytest.mark.parametrize(
    "sizes, weights",
    [
        ({"hot": 9000, **{f"s{i}": 1250 for i in range(19)}}, {"hot": 9000**0.5, **{f"s{i}": 1250**0.5 for i in range(19)}}),
        ({"a": 30_000, "b": 20}, {"a": 0.9999, "b": 0.0001}),
        ({"a": 5000, "b": 5000, "c": 10}, {"a": 1 / 3, "b": 2 / 3, "c": 0.0}),
        ({"a": 700, "b": 300}, {"a": 3.0, "b": 1.0}),
    ],
)
def test_lag_against_the_weights_asked_for(sizes, weights):
    seen = dict.fromkeys(sizes, 0)
    for phase in mixing.plan(sizes, weights):
        active = {k: Fraction(weights[k]) for k in sizes if seen[k] < sizes[k]}
        if not any(active.values()):
            active = dict.fromkeys(active, Fraction(1))
        total = sum(active.values())
        order = [None] * phase["length"]
        for k, (first, n, w, at) in phase["sources"].items():
            assert first == seen[k]
            seen[k] += n
            for j in range(n):
                order[j // w * phase["period"] + at[j % w]] = k
        assert None not in order
        counts = dict.fromkeys(active, 0)
        for i, k in enumerate(order):
            counts[k] += 1
            if i % 50 == 0 or i + 1 == len(order):
                assert all(abs(counts[x] - (i + 1) * active[x] / total) < 1 for x in active)
    assert seen == sizes


def test_plan_reaches_the_documents(spark):
    """interleave() gives each document its block's slot, where slots are listed and where they repeat."""
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, source string")
    for weights in ({"a": 0.7, "b": 0.30001}, {"a": 3.0, "b": 1.0}):
        want = {}
        for p, phase in enumerate(mixing.plan({"a": 300, "b": 150}, weights)):
            for k, (first, n, w, at) in phase["sources"].items():
                want |= {(k, first + j): (p, phase["start"] + j // w * phase["period"] + at[j % w]) for j in range(n)}
        rows = mixing.interleave(docs, weights, block=2).collect()
        assert {(r.source, r.block): (r.phase, r.slot) for r in rows} == want and len(rows) == 900


def test_whole_weights():
    assert mixing.whole_weights({"a": 1, "b": 1, "c": 1}, 10) in ({"a": 4, "b": 3, "c": 3},)
    assert mixing.whole_weights({"a": 1e-9, "b": 1}, 10) == {"a": 1, "b": 9}


def test_documents(documents):
    rows = mixing.interleave(documents, {"src0": 3.0, "src1": 1.0}, block=4).collect()
    assert sorted(r.position for r in rows) == list(range(documents.count()))
    order = sorted(rows, key=lambda r: r.position)
    # Blocks stay whole and in the order of their slots.
    assert [r.slot for r in order] == sorted(r.slot for r in rows)
    blocks = {}
    for r in rows:
        blocks.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in blocks.values())


def test_mix_keeps_all_rows(documents):
    out = mixing.mix(documents)
    assert out.columns == documents.columns and sorted(out.collect()) == sorted(documents.collect())


def test_odd_rows(odd, none):
    rows = mixing.interleave(odd, block=2).collect()
    assert sorted(r.position for r in rows) == list(range(odd.count())) and None in {r.source for r in rows}
    key = lambda r: (r.source or "", r.doc_id or 0)
    assert sorted(map(key, rows)) == sorted(map(key, odd.collect()))
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.interleave(none).collect() == [] and mixing.mix(none).collect() == []


def test_repeated_rows_are_kept(spark):
    """Equal rows, rows of one id with other texts, and null ids have a place each, in mix() and place() too."""
    rows = [(1, "a", "x", None), (1, "a", "x", None), (1, "a", None, "x"), (1, "b", "x", None), (None, "a", "y", None), (None, "a", "z", None), (2, None, "x", {"k": 1}), (2, None, "x", {"k": 1}), (2, None, "x", {"k": 2})]
    docs = spark.createDataFrame([(i, s, t if not isinstance(t, dict) else None, t if isinstance(t, dict) else None) for i, s, t, _ in rows] + [(3, "c", "x", {"k": 1})] * 3, "doc_id long, source string, text string, _k map<string,int>")
    full = lambda df: sorted(repr((r.doc_id, r.source, r.text, r._k)) for r in df.collect())
    assert full(mixing.mix(docs)) == full(docs)
    placed = mixing.place(docs)
    assert full(placed) == full(docs) and sorted(r.position for r in placed.collect()) == list(range(12))
    assert mixing.interleave(docs).count() == 12
