import base64
import hashlib
import io
import json
import zipfile

import pytest

from skytrail.llm import warc


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    p = warc.Package(zip64)
    p.add("a.txt", b"hello")
    p.add("b/ü.bin", bytes(1000))
    data = p.close()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a.txt") == b"hello" and z.namelist() == ["a.txt", "b/ü.bin"]
    reads = []
    a = warc.Archive(lambda at, n: reads.append(n) or data[at : at + n], len(data))
    at = a.start("a.txt")
    assert data[at : at + 5] == b"hello" and a.members["b/ü.bin"][1] == 1000


def test_foreign_archives():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x", "stored")
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"12345")
        z.writestr("c", "a" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    data = buf.getvalue()
    a = warc.Archive(lambda at, n: data[at : at + n], len(data))
    assert data[a.start("big") :][:5] == b"12345"
    with pytest.raises(ValueError, match="compressed"):
        a.start("c")
    with pytest.raises(ValueError):
        warc.Archive(lambda at, n: b"", 0)


def foreign(indexes):
    """A package by another writer: two WARC members of two records each, and these indexes."""
    buf, entries = io.BytesIO(), {}
    with zipfile.ZipFile(buf, "w") as z:
        for i, member in enumerate(("archive/a.warc", "archive/b.warc")):
            data, at = b"", 0
            for page in (2 * i, 2 * i + 1):
                body = f"page {page}".encode()
                data += warc.record(page, f"http://h/{page}", body, warc.digest(body), None)
                entries[page] = {"page_id": page, "filename": member, "offset": at, "length": len(data) - at}
                at = len(data)
            z.writestr(member, data)
        z.writestr("indexes/", "")
        for name, pages in indexes.items():
            z.writestr(name, pages if isinstance(pages, str) else "".join(json.dumps(entries[p]) + "\n" for p in pages))
    data = buf.getvalue()
    return warc.Archive(lambda at, n: data[at : at + n], len(data))


def test_all_indexes_are_read():
    a = foreign({"indexes/b.jsonl": [0, 3], "indexes/a.jsonl": [2, 1]})
    assert [e["page_id"] for e in a.index()] == [2, 1, 0, 3]
    assert [(e["page_id"], head["warc-target-uri"], body) for e, head, body in a.records()] == [(p, f"http://h/{p}", f"page {p}".encode()) for p in (2, 1, 0, 3)]
    with pytest.raises(ValueError, match="indexes/b"):
        foreign({"indexes/a.jsonl": [0], "indexes/b.cdx": "no json"}).index()
    with pytest.raises(ValueError, match="no index"):
        foreign({}).index()


ROWS = [(3, "http://a/\r\nX: y", "same"), (1, "http://b/", "same"), (2, None, None), (5, "u", ""), (4, "u", "x" * 100_000), (None, "u", "same"), (7, "é", "é\r\n\r\n"), (1, "http://b/", "same")]


def test_round_trip(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "p") for r in ROWS], "page_id long, url string, html string, payload string")
    rows = warc.read_archives(warc.write_archives(df)).collect()
    assert len(rows) == len(ROWS)
    texts = {i: (t or "").encode() for i, _, t in ROWS}
    for r in rows:
        b = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert r.payload == (b if r.record_type == "response" else None)
    kind = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kind == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 4: ("response", None), 7: ("response", None)}


def test_short_payloads_and_no_rows(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert all(r.record_type == "response" for r in warc.read_archives(warc.write_archives(df, 10**6)).collect())
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_packages_that_cannot_be_read(spark):
    """Cut, changed, empty and null packages have a row with their error, and nothing raises."""
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 20) for i in range(6)], "page_id long, url string, html string")
    good = [bytes(r.package) for r in warc.write_archives(pages).collect()]
    body = good[0].index(b"page ")
    bad = [b"", b"no zip", good[0][:-30], good[0][:body] + b"P" + good[0][body + 1 :], None, good[0].replace(b"PK\1\2", b"PK\1\3")]
    df = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in good + bad], "package binary")
    rows = warc.read_archives(df).collect()
    assert sum(r.error is not None for r in rows) == len(bad)
    assert {r.page_id for r in rows if r.error is None} == set(range(6))
    assert all(r.payload is None for r in warc.read_archives(df, payloads=False).collect())
