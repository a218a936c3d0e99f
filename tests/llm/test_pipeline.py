import hashlib
import math
import struct
import zlib
from fractions import Fraction

import public_tokenizers
import sentencepiece
from test_jaccard import brute as components
from test_line_dedup import brute as dedup

import corpus_pipeline
from skytrail.llm import quality_rules


def test_against_plain_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    # The learned rules are taken as they are; what follows is done in plain Python.
    verdict, _ = quality_rules.judge(quality_rules.counts(docs.select("doc_id", "text")).drop("text"), labels)
    kept = {r.doc_id for r in verdict.filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = [(i, t) for i, _, t in dedup(rows)]
    comp = components(rows, 5, 80, 100)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(ids := sp.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in rows}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(want)


def plain_mixture(docs, block=16):
    """(source, doc_id) -> (phase, slot, position), from documents of each source in their order."""
    blocks = {k: [v[i : i + block] for i in range(0, len(v), block)] for k, v in docs.items()}
    weights = {k: Fraction(len(v) ** 0.5) for k, v in docs.items()}
    out, slot, phase, position = {}, 0, 0, 0
    while blocks:
        total = sum(weights[k] for k in blocks)
        share = {k: weights[k] / total for k in blocks}
        done, t = dict.fromkeys(blocks, 0), 0
        while all(done[k] < len(blocks[k]) for k in blocks):
            ready = [(math.ceil((done[k] + 1) / share[k]), k) for k in blocks if math.floor(done[k] / share[k]) <= t]
            _, k = min(ready)
            for i in blocks[k][done[k]]:
                out[k, i] = phase, slot, position
                position += 1
            done[k] += 1
            t, slot = t + 1, slot + 1
        blocks = {k: left for k in blocks if (left := blocks[k][done[k] :])}
        phase += 1
    return out


def test_mixture_reaches_the_rows(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").selectExpr("*", "xxhash64(doc_id, 42) h").collect()
    # The ids and spans themselves are the output; the digests are theirs.
    for r in rows:
        assert r.n_tokens == len(r.ids) and len(r.spans) == 2 * len(r.ids)
        assert hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
        assert zlib.crc32(struct.pack(f"<{len(r.spans)}q", *r.spans)) == r.spans_crc32
    docs = {}
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        docs.setdefault(r.source, []).append(r.doc_id)
    assert {(r.source, r.doc_id): (r.phase, r.slot, r.position) for r in rows} == plain_mixture(docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes, name
