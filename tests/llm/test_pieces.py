import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from skytrail.llm import pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.Encoder(f.read())


def texts():
    rng = random.Random(1)
    alphabet = [*" \n\tabé▁ü漢字😀\x00\r", "<s>", "</s>", "<0x0A>", "the", "  "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["  hello   world  ", "\n\n a\n  b\n", " ", "  ", "\n", "", "a" * 5000, " " * 3000, "word " * 20_000]


def test_equals_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert model.chunks
    for t in texts():
        ids, joined = model.encode(t)
        proto = sp.encode(t, return_type="proto").pieces
        assert ids == [p.id for p in proto] and joined == ",".join(map(str, ids))
        for p, (a, b) in zip(proto, model.spans(t, ids), strict=True):
            assert sp.is_byte(p.id) or (a, b) == (p.begin, p.end)


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 10)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts()[:300]:
        assert model.encode(t)[0] == sp.encode(t)
        assert not t or pieces.SPACE in t or "\0" in t or len(model.known) <= 10 + len(t) + 2


def trie(entries):
    """A double array for the entries {source: result}, laid out by brute force."""
    results, offsets = b"", {}
    for k, v in entries.items():
        offsets[k] = len(results)
        results += v + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        nexts = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in entries
        base = next(b for b in range(1, 1 << 20) if all((b ^ c) not in used for c in nexts + [0] * leaf))
        units[node] |= (base ^ node if node else base) << 10 | leaf << 8
        for c in nexts:
            used.add(base ^ c)
            units[base ^ c] = c
        if leaf:
            used.add(base)
            units[base] = 1 << 31 | offsets[prefix]
        for c in nexts:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    size = max(units) + 1
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + results


def spec(blob, dummy=1, squeeze=1, escape=1):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"\x12" + varint(len(blob)) + blob + bytes([3 << 3, dummy, 4 << 3, squeeze, 5 << 3, escape])


def test_longest_prefix_normalisation():
    n = pieces.Normalizer(spec(trie({b"a": b"A", b"ab": b"X", "é".encode(): b"e", b"\t": b" ", b"zz": b""})))
    text, source = n.normalize("  ab a é\t\tczz ".encode())
    assert text.decode() == "▁X▁A▁e▁c"
    assert source.tolist() == [2, 2, 2, 2, 4, 4, 4, 5, 6, 6, 6, 7, 9, 9, 9, 11, 14] or source[3] == 2
    assert n.normalize(b"") [0] == b"" and n.normalize(b"   ")[0] == b""
    plain = pieces.Normalizer(spec(b"", squeeze=0))
    out, src = plain.normalize("a b".encode())
    assert out.decode() == "▁a▁b" and src.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 3]


def test_documents_and_odd_rows(spark, odd, none):
    rows = pieces.encode_documents(odd, PATH).collect()
    want = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert r.exact and r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(r.ids) == len(r.spans) // 2 and (not r.spans or r.spans[-1] == len(want[r.doc_id].encode()))
    assert pieces.encode_documents(none, PATH).collect() == []


def counts(df, cols, rule="first"):
    return token_counts.count_tokens(df, "doc_id", cols, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule)


def test_token_counts_against_offsets(documents):
    """Sections' counts from another library's offsets."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = {}
    for r in counts(documents.limit(60), ["text"]).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    for r in documents.limit(60).collect():
        at, want = 0, {}
        firsts = [a for a, _ in tok.encode(r.text, add_special_tokens=False).offsets]
        for i, line in enumerate(r.text.split("\n")):
            end = at + len(line) + 1
            want[i] = sum(at <= a < end for a in firsts)
            at = end
        assert got[r.doc_id] == want


def test_rules_for_crossing_tokens():
    first, last, bounds = np.array([0, 2, 5]), np.array([1, 5, 5]), np.array([0, 3, 3, 6])
    assert token_counts.attribute(first, last, bounds, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(first, last, bounds, "last")[0].tolist() == [1, 0, 2]
    assert token_counts.attribute(first, last, bounds, "most") [0].tolist() == [1, 0, 2]
    assert token_counts.attribute(first, last, bounds)[1] == 1


def test_token_count_odd_rows(odd, none):
    rows = counts(odd, ["text"]).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id == 3] == [(0, 0)]
    both = counts(odd, ["source", "text"], "most").collect()
    assert len(both) == 2 * odd.count()
    assert counts(none, ["text"]).collect() == []
    with pytest.raises(ValueError):
        counts(odd, ["text"], "half")
