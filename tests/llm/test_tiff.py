import hashlib
import struct
import zlib

import numpy as np
import pytest

from skytrail.llm import tiff

rng = np.random.default_rng(1)
PAGES = [
    rng.integers(0, 255, (1, 1, 1), dtype=np.uint8),
    rng.integers(0, 4, (33, 70, 3), dtype=np.uint8),
    rng.integers(0, 65535, (40, 50, 1), dtype=np.uint16),
    np.repeat(rng.integers(0, 255, (200, 1, 1), dtype=np.uint8), 64, 1),
    rng.integers(0, 255, (300, 64, 1), dtype=np.uint8),
]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("method", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_round_trip(method, predictor, tile, order):
    data = tiff.write_tiff(PAGES, method, predictor, 16, tile, order)
    got = list(tiff.read_pages(data))
    assert len(got) == len(PAGES) and all(np.array_equal(a, b.pixels) for a, b in zip(PAGES, got, strict=True))


def test_known_codes():
    """The examples of the format's specification."""
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert tiff.unpack_packbits(packed, 99) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA".replace(" ", ""))
    assert tiff.unpack_lzw(tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_floating_point_predictor():
    a = rng.normal(size=(3, 5)).astype(np.float32)
    planes = np.ascontiguousarray(a.astype(">f4")).view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    diff = np.concatenate((planes[:, :1], planes[:, 1:] - planes[:, :-1]), axis=1).tobytes()
    got = tiff.undo_predictor(np.zeros((3, 5, 1), np.float32), 3, diff, "<")
    assert np.array_equal(got[..., 0], a)


def test_query_columns_and_odd_rows(spark, odd, none):
    rows = tiff.tiff_files(tiff.text_media(odd)).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    by = {}
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        pad = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(b), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), None)
        assert by.setdefault(b, r.feature) == r.feature and r.width == 64
    assert tiff.tiff_pages(tiff.text_media(none)).collect() == [] == tiff.tiff_files(tiff.text_media(none)).collect()


def test_bad_files_are_reported(spark):
    good = tiff.write_tiff(PAGES[:2])
    cut = good[:8] + struct.pack("<I", 10**6) + good[12:]
    df = spark.createDataFrame([(1, 0, bytearray(b"no")), (2, 0, bytearray(cut[:40])), (3, 0, None), (4, 0, bytearray(good))], "doc_id long, n_bytes long, media binary")
    rows = tiff.tiff_pages(df).collect()
    assert [(r.doc_id, r.page, r.error is None) for r in rows] == [(1, None, False), (2, None, False), (4, 0, True), (4, 1, True)]


def test_long_text_has_several_pages_and_all_forms_are_used(spark):
    texts = [str(i) * 40 for i in range(80)] + ["page" * 200_000, "x" * tiff.SIDE * tiff.PAGE_ROWS]
    media = tiff.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pages = {}
    for r in sorted(tiff.tiff_pages(media).collect(), key=lambda r: (r.doc_id, r.page)):
        pages.setdefault(r.doc_id, []).append((r.page, r.height))
    assert pages[80] == [(0, 4096), (1, 4096), (2, 4096), (3, 212)] and pages[81] == [(0, 4096)]
    used = set()
    for r in media.collect():
        order, tags = next(tiff.directories(bytes(r.media)))
        used.add((tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tags.get(tiff.TILE_WIDTH, (0,))[0], order))
    assert used == set(tiff.FORMS)
    for r in tiff.tiff_files(media).collect():
        b = texts[r.doc_id].encode()
        assert r.payload_sha256 == hashlib.sha256(b + bytes(-len(b) % 64)).hexdigest()


def test_malformed_files_never_raise(monkeypatch):
    """Files with some bytes changed, and some that claim much: pages or an error, never an exception."""
    draw = np.random.default_rng(8)
    files = [tiff.write_tiff(PAGES[:3], m, p, 16, t, o) for m in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p, t, o in ((1, 0, "<"), (2, 16, ">"))]
    huge = tiff.write_tiff([PAGES[1]]).replace(struct.pack("<HHII", tiff.WIDTH, 4, 1, 70), struct.pack("<HHII", tiff.WIDTH, 4, 1, 4_000_000_000)).replace(struct.pack("<HHII", tiff.HEIGHT, 4, 1, 33), struct.pack("<HHII", tiff.HEIGHT, 4, 1, 4_000_000_000))
    floats = tiff.write_tiff([PAGES[0]]).replace(struct.pack("<HHIHH", tiff.PREDICTOR, 3, 1, 2, 0), struct.pack("<HHIHH", tiff.PREDICTOR, 3, 1, 3, 0))
    bad = [huge, floats]
    for i in range(1000):
        data = bytearray(files[i % len(files)])
        tail = len(data) - 400  # mostly in the directories, which the writer puts behind the samples
        for _ in range(draw.integers(1, 6)):
            data[draw.integers(max(0, tail), len(data)) if draw.random() < 0.8 else draw.integers(0, len(data))] = draw.integers(0, 256)
        bad.append(bytes(data[: draw.integers(0, len(data))] if i % 10 == 0 else data))
    real = tiff.np.zeros
    monkeypatch.setattr(tiff.np, "zeros", lambda shape, *a: real(shape, *a) if np.prod(shape, dtype=float) < 1e8 else pytest.fail("much is allocated"))
    batch = tiff.pa.RecordBatch.from_arrays([tiff.pa.array(range(len(bad))), tiff.pa.array([0] * len(bad)), tiff.pa.array(bad, tiff.pa.binary())], ["doc_id", "n_bytes", "media"])
    for whole in (False, True):
        rows = next(tiff.page_batches(whole)(iter([batch]))).to_pylist()
        assert {r["doc_id"] for r in rows} == set(range(len(bad)))
        errors = [r for r in rows if r["error"]]
        assert {0, 1} <= {r["doc_id"] for r in errors} and len(errors) > 100
