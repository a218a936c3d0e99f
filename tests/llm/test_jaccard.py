import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skytrail.llm import jaccard_join, shingles


def sets_of(docs, k):
    out = {}
    for i, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(docs, k, num, den):
    s = sets_of(docs, k)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = {}
    for i in ids:
        both = Counter(j for x in s[i] for j in holders.get(x, ()))
        for j, o in both.items():
            if den * o >= num * (len(s[i]) + len(s[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s[i]:
            holders.setdefault(x, []).append(i)
    return {i: (len(s[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("words,num,den,list_rows,bits", [(4, 85, 100, 100_000, 24), (5, 80, 100, 8, 6)])
def test_against_brute_force(spark, documents, words, num, den, list_rows, bits):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = jaccard_join.jaccard_components(documents, words, num, den, list_rows, bits)
    assert result(got) == brute(docs, words, num, den)


def test_groups_of_near_copies(spark):
    """Chains of edits of a few texts, whose links overlap; lists are cut into small blocks."""
    rng = random.Random(5)
    docs = []
    for g in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(60):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 12))):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                base = t
            docs.append((len(docs), " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 4, 85, 100)
    assert 4 <= len({c for _, c in want.values()}) < len(docs)
    assert result(jaccard_join.jaccard_components(df, list_rows=16)) == want
    assert result(jaccard_join.jaccard_components(df)) == want


def test_odd_rows(odd, none):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == got[2] and got[2][1] == 1
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[7] == (0, 7)
    assert got[5] == (1, 5) and got[6] == (1, 5) and got[8] == (1, 8) and got[10] == (1, 10)
    assert got[None] == got[1]
    assert jaccard_join.jaccard_components(none).collect() == []
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and 2 not in [r.doc_id for r in kept.collect()]


def test_shingles_over_pieces_and_groups(monkeypatch):
    monkeypatch.setattr(shingles, "GROUP_BYTES", 64)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("a", "Bb", "ccc", "dé")) + rng.choice("xyz") for _ in range(rng.randrange(0, 90))) for _ in range(50)] + [None, "", " \n "]
    small = {}
    for lo, hi, h, b in shingles.shingle_sets(pa.array(texts, pa.string()).slice(3), 4):
        small |= {i: set(h[b[i - lo] : b[i - lo + 1]].tolist()) for i in range(lo, hi)}
    monkeypatch.setattr(shingles, "GROUP_BYTES", 1 << 20)
    want = sets_of(enumerate(texts[3:]), 4)
    for lo, hi, h, b in shingles.shingle_sets(pa.array(texts[3:], pa.string()), 4):
        for i in range(lo, hi):
            assert set(h[b[i - lo] : b[i - lo + 1]].tolist()) == small[i] and len(small[i]) == len(want[i])
            assert (np.diff(h[b[i - lo] : b[i - lo + 1]].astype(object)) > 0).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)
        y = np.concatenate((x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)))
        assert jaccard_join.differ(jaccard_join.parities(x), jaccard_join.parities(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_words_of_two_letters_in_an_order_that_polynomials_confuse(spark):
    """The Thue-Morse word and its opposite have one polynomial hash modulo any power of two."""
    for n in (10, 12):
        t = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        rows = [(1, t), (2, t.translate(str.maketrans("ab", "ba"))), (3, t + " "), (4, t[:-1])]
        assert result(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4)}


def test_word_hashes_do_not_hang_on_the_place():
    rng = random.Random(2)
    words = {"".join(rng.choice("aB\x00é") for _ in range(rng.randrange(1, 90))) for _ in range(3000)}
    lower = {w.replace("B", "b") for w in words}
    seen = {}
    for lead in ("", "x ", "abcdefg  "):
        text = (lead + " ".join(sorted(words))).encode()
        h, s = shingles._words(np.frombuffer(text, np.uint8), np.zeros(0, np.int64))
        for w, v in zip(text.decode().split(" "), [v for v in h.tolist()], strict=False) if not lead else ():
            seen[w.replace("B", "b")] = v
        skip = len(lead.split())
        assert [v for v in h.tolist()[skip:]] == [seen[w.replace("B", "b")] for w in sorted(words)]
    assert len(set(seen.values())) == len(lower)
