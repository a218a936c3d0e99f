"""SentencePiece encoding and decoding with offsets: longest-prefix normalisation through the
compiled character map records the source of every byte, so that each piece has its span of
original bytes."""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bounded_batches, table

SPACE = "▁"  # stands for a space in pieces
CACHE = 300_000  # chunks whose ids a worker remembers
CACHED_CHARS = 48


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie of sources, then the zero-ended results."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.results = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The result and the length of the longest source that data has at this place."""
        if not self.units:
            return None
        units, found = self.units, None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & 1 << 9) >> 6)

        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & (1 << 31 | 255) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.results[start : self.results.index(b"\0", start)], found[1]


class Normalizer:
    def __init__(self, spec: bytes):
        got = dict(fields(spec))
        self.map = CharMap(got.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Result and length of the next source: the longest in the map, or else a character."""
        if hit := self.map.longest(data, at):
            return hit
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte it comes from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        space = SPACE.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, len(space), 1)
            source = np.repeat(np.arange(len(data)), width)
            lead = np.zeros(len(space) if self.dummy_prefix else 0, np.int64)
            text = (space if self.dummy_prefix else b"") + data.replace(b" ", space)
            return text, np.concatenate((lead, source, [len(data)]))
        at = 0
        while self.squeeze and at < len(data):
            result, n = self.step(data, at)
            if result != b" ":
                break
            at += n
        if at >= len(data):
            return b"", np.array([at])
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += space
            source += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            result, n = self.step(data, at)
            if after_space:
                result = result.lstrip(b" ")
            if result:
                made = result.replace(b" ", space)
                out += made
                source += [at] * len(made)
                after_space = result.endswith(b" ")
            at += n
            after_space = after_space and self.squeeze
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            at = source[len(out)]
            del source[len(out) :]
        return bytes(out), np.array([*source, at], np.int64)


class Encoder:
    """Encodes and decodes exactly as the library does, and gives the pieces' original spans."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        message = list(fields(model))
        pieces = [dict(fields(v)) for k, v in message if k == 1]
        names = [p.get(1, b"").decode() for p in pieces]
        self.normalizer = Normalizer(next((v for k, v in message if k == 3), b""))
        kinds = [p.get(3, 1) for p in pieces]  # 6: byte pieces, which stand for one byte each
        self.sizes = np.array([1 if k == 6 else len(n.encode()) for k, n in zip(kinds, names, strict=True)], np.int64)
        usual = [n for k, n in zip(kinds, names, strict=True) if k in (1, 4)]
        newline = self.sp.piece_to_id("<0x0A>")
        # Pieces that hold no space after another character, and no line end, cannot cross from one
        # chunk (spaces and a word) into the next; chunks can then be encoded apart and remembered.
        n = self.normalizer
        self.chunks = 4 not in kinds and n.dummy_prefix and n.escape and not n.squeeze and not n.map.units and all(SPACE not in x.lstrip(SPACE) and "\n" not in x for x in usual) and self.sp.encode("\n") == [self.sp.piece_to_id(SPACE), newline]
        self.newline = newline
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    CHUNK = re.compile(r" *[^ \n]+| +|\n")

    def learn(self, chunks: list[str]) -> None:
        """Encodes the chunks, which hold no line end, as the lines of one text after an empty line."""
        ids = np.array(self.sp.encode("\n" + "\n".join(chunks)), np.int64)
        cuts = np.flatnonzero(ids == self.newline)
        if len(cuts) != len(chunks):
            raise ValueError("a line end was lost")
        flat, edges = ids.tolist(), [*cuts.tolist(), len(ids)]
        for c, s, e in zip(chunks, edges[:-1], edges[1:], strict=True):
            part = tuple(flat[s + 1 : e])
            self.known[c] = part, ",".join(map(str, part))

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and their decimals joined by commas."""
        if not text:
            return [], ""
        if not self.chunks or SPACE in text or "\0" in text:
            ids = self.sp.encode(text)
            return ids, ",".join(map(str, ids))
        chunks = self.CHUNK.findall(" " + text)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        known["\n"] = (self.newline,), str(self.newline)
        if new := [c for c in set(chunks) if c not in known]:
            self.learn(new)
        found = [known[c] for c in chunks]
        out = list(itertools.chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])
        for c in new:
            if len(c) > CACHED_CHARS:
                del known[c]
        return out

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(begin, end) of each piece in the UTF-8 bytes of the text."""
        normal, source = self.normalizer.normalize(text.encode())
        ends = np.cumsum(self.sizes[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        if len(ends) and ends[-1] != len(normal):
            # Pieces without byte fallback: their sizes come from the library's own surfaces.
            raise ValueError("the pieces do not cover the normalised text")
        return np.stack((source[np.concatenate(([0], ends[:-1])).astype(np.int64)], source[ends]), axis=1) if len(ends) else np.zeros((0, 2), np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode_batches(model: bytes, keep: bool, carry: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            out: list[list] = [[] for _ in range(7 if keep else 5)]
            for text in b.column(1).to_pylist():
                text = text or ""
                ids, joined = enc.encode(text)
                spans = enc.spans(text, ids)
                back = enc.decode(ids)
                row = [len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text, zlib.crc32(spans.astype("<i8").tobytes())]
                for col, v in zip(out, row + [ids, spans.ravel()] * keep, strict=False):
                    col.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact", "spans_crc32", "ids", "spans"][: len(out) + 1]
            carried = range(2, 2 + carry)
            cols = [b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=False)), *(b.column(i) for i in carried)]
            yield pa.RecordBatch.from_arrays(cols, names + [b.schema.names[i] for i in carried])

    return run


def encode_documents(docs: DataFrame, model_path: str, keep: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, digests of ids, decoded text and spans, exact (the decoded
    text is the text); with keep also ids, and spans as begin, end, begin, end, ...; then the columns of docs that are carried along.

    Null text counts as empty and has no ids.  Ties and repeated rows do not matter.
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean, spans_crc32 long" + ", ids array<int>, spans array<long>" * keep + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return rows.mapInArrow(encode_batches(model, keep, len(carry)), schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, model_path(), keep=False)
