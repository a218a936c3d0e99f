"""Token counts by offset-mapped attribution: documents are encoded whole and once, token character
spans are joined to the spans of their sections, and an explicit rule allocates tokens that cross."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bounded_batches, table

RULES = ("first", "last", "most")


class Spans:
    """A byte-level BPE whose tokens' byte lengths are known, and so their character spans."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last character of each token, and the code points as bytes mark them."""
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.sizes[np.asarray(self.bpe.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        return char[starts] if len(ends) else ends, char[ends - 1] if len(ends) else ends, char


def attribute(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a bound.

    Sections are [bounds[i], bounds[i + 1]) in characters.  A token that crosses goes to the section
    of its first character, of its last, or of most of its characters (ties: the earliest).
    Every token counts once; empty sections get none.
    """
    n = len(bounds) - 1
    a, b = (np.searchsorted(bounds, x, side="right") - 1 for x in (first, last))
    to = b if rule == "last" else a.copy()
    crossing = np.flatnonzero(a != b)
    if rule == "most":
        for i in crossing:
            k = np.arange(a[i], b[i] + 1)
            held = np.minimum(bounds[k + 1], last[i] + 1) - np.maximum(bounds[k], first[i])
            to[i] = k[np.argmax(held)]
    return np.bincount(to, minlength=n), len(crossing)


def line_bounds(text: str) -> np.ndarray:
    """Sections are lines; a line end belongs to the line that it ends."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.concatenate(([0], at, [len(text)])).astype(np.int64)


@lru_cache(maxsize=2)
def spans_of(vocabulary: bytes, pattern: str) -> Spans:
    return Spans(vocabulary, pattern)


def count_batches(vocabulary: bytes, pattern: str, rule: str):
    """Rows: (id, field columns...).  One field: its lines are the sections; several: the fields are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = spans_of(vocabulary, pattern)
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            nulls: list[np.ndarray] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts = [x or "" for x in row[1:]]
                whole = texts[0] if len(texts) == 1 else "\n".join(texts)
                if len(texts) == 1:
                    bounds = line_bounds(whole)
                else:
                    bounds = np.cumsum([0, *(len(x) + 1 for x in texts[:-1]), len(texts[-1])])
                first, last, _ = spans(whole)
                counts, crossing = attribute(first, last, bounds, rule)
                n = len(counts)
                for c, v in zip(cols, (np.full(n, -1 if row[0] is None else row[0]), np.arange(n), bounds[:-1], bounds[1:], counts, np.full(n, crossing)), strict=True):
                    c.append(v)
                nulls.append(np.full(n, row[0] is None))
            joined = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols]
            mask = np.concatenate(nulls) if nulls else None
            yield pa.RecordBatch.from_arrays([pa.array(joined[0], mask=mask), *(pa.array(x) for x in joined[1:])], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return run


def count_tokens(docs: DataFrame, id_col: str, fields: list[str], path: str, pattern: str, rule: str = "first") -> DataFrame:
    """A row a section: doc_id, section, start, stop (characters of the whole text), n_tokens,
    n_crossing (tokens of the document that cross a bound).

    One field: sections are its lines.  Several: they are joined by line ends, encoded as one text,
    and are the sections.  Null fields count as empty; an empty text has one section of no tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(docs.sparkSession)
    with open(path, "rb") as f:
        vocabulary = f.read()  # read here, so that the executors need no file
    cols = [F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields))]
    return docs.select(*cols).mapInArrow(count_batches(vocabulary, pattern, rule), "doc_id long, section long, start long, stop long, n_tokens long, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, "doc_id", ["text"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
