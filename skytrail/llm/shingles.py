"""Sets of hashed word shingles, computed over the bytes of whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GROUP_BYTES = 1 << 20
LONG_WORD = 64  # bytes; longer words are hashed one by one
_RNG = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]  # A-Z count as a-z
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # masks of the first bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of bytes b, and where it starts; no word goes over one of the cuts.

    Words are mixed eight bytes at a time, each step one to one in those bytes; words of one length
    of up to eight bytes never collide.
    """
    black = ((b - np.uint8(9)) > 4) & (b != 32)
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(b))]
    first[cuts] = black[cuts]
    last[cuts - 1] = black[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = np.zeros(len(b) + 8, np.uint8)
    np.take(_LOWER, b, out=low[: len(b)])
    eight = np.ndarray(len(b) + 1, "<u8", low.data, 0, (1,))  # the eight bytes from each place on
    size = e - s
    out = mix(size.astype(np.uint64) * _STEP[-1])
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        out[at] = mix((out[at] ^ (eight[s[at] + done] & _FIRST[np.minimum(8, size[at] - done)])) * _STEP[-2])
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(low[s[i] : e[i]])
    return out, s


def _long_words(b: np.ndarray) -> np.ndarray:
    """The words of one long text, in pieces that end between words."""
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + GROUP_BYTES)
        while end < len(b) and not (b[end] == 32 or 9 <= b[end] <= 13):
            end += 1
        out.append(_words(b[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hashes, bounds) of groups of rows lo..hi-1: bounds[i]:bounds[i + 1] are the sorted
    distinct hashes of row lo + i.  Texts of fewer than k words have their whole sequence as one
    shingle; texts without words, and nulls, have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, side="right")) - 1)
        b = data[offsets[lo] : offsets[hi]]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        if hi == lo + 1 and len(b) > 2 * GROUP_BYTES:
            w = _long_words(b)
            doc = np.zeros(len(w), np.int64)
        else:
            w, s = _words(b, cuts)
            doc = np.searchsorted(cuts, s, side="right") - 1
        n = np.bincount(doc, minlength=hi - lo)
        if len(w) >= k:
            h = np.zeros(len(w) - k + 1, np.uint64)
            for i in range(k):
                h += w[i : len(w) - k + 1 + i] * _STEP[i]
            inside = doc[: len(h)] == doc[k - 1 :]
            h, doc_h = mix(h[inside]), doc[: len(h)][inside]
        else:
            h, doc_h = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        counts = np.bincount(doc_h, minlength=hi - lo)
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            at = np.concatenate(([0], np.cumsum(n)))
            # Sums go through arrays, where overflow wraps without a warning.
            one = np.array([np.sum(np.append(w[at[i] : at[i + 1]] * _STEP[: n[i]], _STEP[k + n[i]])) for i in few], np.uint64)
            where = np.concatenate(([0], np.cumsum(counts)))[few]
            h, doc_h = np.insert(h, where, mix(one)), np.insert(doc_h, where, few)
            counts[few] = 1
        bounds = np.concatenate(([0], np.cumsum(counts)))
        for i in np.flatnonzero(counts > 1):
            h[bounds[i] : bounds[i + 1]].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc_h[1:] != doc_h[:-1])
        h, doc_h = h[new], doc_h[new]
        yield lo, hi, h, np.concatenate(([0], np.cumsum(np.bincount(doc_h, minlength=hi - lo))))
        lo = hi
