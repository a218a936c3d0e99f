"""TIFF media column: walks image directories, decodes PackBits, LZW and deflate strips and tiles,
undoes predictors, and emits one row per page; the writer makes such files."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bounded_batches, table

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}

SIDE = 64  # width of the images that hold a payload
STRIP_ROWS = 1024
PAGE_ROWS = 4096  # longer payloads have several pages
#: No method makes more bytes of one (LZW: codes of 12 bits for words of at most 3839 bytes).
EXPANSION = 4096
FAULTS = (ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error, zlib.error)


class TiffError(ValueError):
    pass


def unpack_packbits(data: bytes, limit: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_packbits(row: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(row):
        run = 1
        while i + run < len(row) and run < 128 and row[i + run] == row[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, row[i]))
            i += run
            continue
        j = i + 1
        while j < len(row) and j - i < 128 and not (j + 1 < len(row) and row[j] == row[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += row[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, limit: int) -> bytes:
    """At least `limit` bytes, if there are as many.  Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; widths grow one code early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, width, before = base.copy(), 9, None
    out, made, hold, bits = [], 0, 0, 0
    for byte in data:
        if made >= limit:
            break
        hold, bits = (hold << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = hold >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            known, width, before = base.copy(), 9, None
            continue
        if code < len(known):
            word = known[code]
        elif before is not None and code == len(known):
            word = before + before[:1]
        else:
            raise TiffError("bad LZW code")
        out.append(word)
        made += len(word)
        if before is not None and len(known) < 4096:
            known.append(before + word[:1])
        before = word
        if len(known) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, hold, bits, width = bytearray(), 256, 9, 9
    known = {bytes((i,)): i for i in range(256)}
    size, word = 258, b""

    def put(code: int) -> None:
        nonlocal hold, bits
        hold, bits = hold << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(hold >> bits & 255)
        hold &= (1 << bits) - 1

    bits, hold = 0, 0
    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            known, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(known[word])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(hold << 8 - bits & 255)
    return bytes(out)


def unpack(data: bytes, method: int, limit: int) -> bytes:
    """The block's bytes; what goes beyond `limit` bytes is not unpacked."""
    if method == NONE:
        return data
    if method in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, limit))
    if method == LZW:
        return unpack_lzw(data, limit)
    if method == PACKBITS:
        return unpack_packbits(data, limit)
    raise TiffError(f"compression {method} is not supported")


def undo_predictor(block: np.ndarray, predictor: int, raw: bytes, order: str) -> np.ndarray:
    """block: (rows, columns, samples)."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3 and block.dtype.kind != "f":
        raise TiffError("predictor 3 is for floating point samples")
    if predictor == 3:  # floating point: bytes are dealt into planes, high bytes first, then differenced
        rows, cols, samples = block.shape
        size = block.dtype.itemsize
        flat = np.frombuffer(raw, np.uint8)[: block.nbytes].reshape(rows, -1)
        step = flat.reshape(rows, -1, samples)
        planes = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols, samples).astype(f"f{size}")
    raise TiffError(f"predictor {predictor} is not supported")


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray  # (height, width, samples)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory; a directory that was seen before ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise TiffError("a directory lies outside the file")
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code = TYPE_CODES.get(kind)
            if code is None:
                continue
            where, size = at + 10 + 12 * i, count * struct.calcsize(order + code)
            if size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if where + size > len(data):
                raise TiffError(f"tag {tag} lies outside the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    """The page of one directory.  Its size is held against its strips' bytes before anything is made."""

    def one(tag: int, default: int) -> int:
        value = tags.get(tag) or (default,)
        if not isinstance(value[0], int):
            raise TiffError(f"tag {tag} is not a whole number")
        return value[0]

    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, method, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16, 32, 64):
        raise TiffError(f"{bits} bits a sample are not supported")
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1), "u")
    if kind == "f" and bits == 8:
        raise TiffError("floating point samples of 8 bits are not supported")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height) or 1)
    offsets, counts = (tags.get(k, ()) for k in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if min(width, height, samples, bw, bh) < 1:
        raise TiffError("the page has no samples")
    across, down = -(-width // bw), -(-height // bh)
    planes, per = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    if not all(isinstance(x, int) and x >= 0 for x in (*offsets, *counts)):
        raise TiffError("offsets and counts must be whole numbers")
    held = sum(min(n, max(0, len(data) - at)) for at, n in zip(offsets, counts, strict=False))
    if width * height * samples * dtype.itemsize > held * (1 if method == NONE else EXPANSION) or bw * bh * per * dtype.itemsize > len(data) * EXPANSION:
        raise TiffError("the page is larger than its strips or tiles can hold")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for i in range(across * down * planes):
        plane, k = divmod(i, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = unpack(data[offsets[i] : offsets[i] + counts[i]], method, rows * bw * per * dtype.itemsize)
        if len(raw) < rows * bw * per * dtype.itemsize:
            raise TiffError("a strip or tile is cut short")
        block = np.frombuffer(raw, dtype, rows * bw * per).reshape(rows, bw, per)
        block = undo_predictor(block.astype(out.dtype) if predictor == 2 else block, predictor, raw, order)
        block = block[: height - y, : width - x]
        out[y : y + block.shape[0], x : x + block.shape[1], plane if planar == 2 else slice(None)] = block[..., 0] if planar == 2 else block
    return Page(width, height, samples, bits, method, out)


def read_pages(data: bytes) -> Iterator[Page]:
    for order, tags in directories(data):
        yield read_page(data, order, tags)


def write_tiff(pages: list[np.ndarray], method: int = DEFLATE, predictor: int = 2, rows_per_strip: int = STRIP_ROWS, tile: int = 0, order: str = "<") -> bytes:
    """Pages are (height, width, samples) arrays of unsigned integers; tile: side of square tiles, 0: strips."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w, s = page.shape
        bw, bh = (tile, tile) if tile else (w, rows_per_strip)
        offsets, counts = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = page[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != (bh, bw):
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
                raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
                if method == PACKBITS:
                    step = len(raw) // block.shape[0]
                    raw = b"".join(pack_packbits(raw[i : i + step]) for i in range(0, len(raw), step))
                elif method != NONE:
                    raw = pack_lzw(raw) if method == LZW else zlib.compress(raw, 1)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [page.itemsize * 8] * s), COMPRESSION: (3, [method]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [s]), PREDICTOR: (3, [predictor]), PLANAR: (3, [1])}
        tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [bh]), STRIP_COUNTS: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            packed = struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


#: (method, predictor, side of tiles or 0 for strips, byte order): most payloads have the first form,
#: a sixteenth each of the others, by their checksum.
FORMS = [(DEFLATE, 2, 0, "<"), (LZW, 2, 0, "<"), (PACKBITS, 1, 0, ">"), (DEFLATE, 1, 64, "<"), (LZW, 1, 32, ">")]


def media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media, sizes = [], []
        for text in b.column(1):
            buf = text.as_buffer() if text.is_valid else None
            n = buf.size if buf else 0
            pixels = np.zeros(max(1, -(-n // SIDE)) * SIDE, np.uint8)
            if n:
                pixels[:n] = np.frombuffer(buf, np.uint8)
            pixels = pixels.reshape(-1, SIDE, 1)
            draw = zlib.crc32(pixels) % 16
            method, predictor, tile, order = FORMS[draw if draw < len(FORMS) else 0]
            media.append(write_tiff([pixels[i : i + PAGE_ROWS] for i in range(0, len(pixels), PAGE_ROWS)], method, predictor, tile=tile, order=order))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of
    64, as greyscale pages 64 samples wide and up to PAGE_ROWS high, in one of FORMS.  Null text
    counts as empty; equal texts have equal media."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(media_batches, "doc_id long, n_bytes long, media binary")


def feature(pixels: np.ndarray) -> str:
    """Size, mean, and an average hash: which of the 64 columns are brighter than the image."""
    total, columns = int(pixels.sum(dtype=np.int64)), pixels.sum(axis=0, dtype=np.int64).ravel()
    bits = int.from_bytes(np.packbits(columns * len(columns) > total).tobytes(), "big")
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{total // pixels.size}:{bits:016x}"


def page_row(doc, n, page: int | None, pixels: np.ndarray, size: int, sha: str, features: bool) -> tuple:
    raw = pixels.tobytes()
    return doc, n, page, pixels.shape[1], pixels.shape[0], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), size, sha, feature(pixels) if features else None, None


def page_batches(whole: bool):
    """(doc_id, n_bytes, media) to a row a page, or with whole a row a file, whose pages follow one
    another; null media has no row, a bad file one row with its error after those of its good pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not media.is_valid:
                    continue
                data = media.as_buffer().to_pybytes()
                sha = hashlib.sha256(data).hexdigest()
                try:
                    if whole:
                        pages = list(read_pages(data))
                        pixels = np.concatenate([p.pixels for p in pages])
                        rows.append(page_row(doc, n, None, pixels, len(data), sha, pixels.dtype == np.uint8))
                        continue
                    for i, p in enumerate(read_pages(data)):
                        rows.append(page_row(doc, n, i, p.pixels, len(data), sha, p.bits == 8))
                except FAULTS as e:
                    rows.append((doc, n, None, None, None, None, None, None, len(data), sha, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [()] * len(PAGES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PAGES, strict=True)], schema=PAGES)

    return run


PAGES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])


PAGES_DDL = "doc_id long, n_bytes long, page int, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row a page of each TIFF in (doc_id, n_bytes, media), with digests of its decoded samples.

    Null media has no row.  A malformed file has a row with its error, and no page number, after the
    rows of the pages before the fault.  Ids may be null or repeated; other columns are not read.
    """
    bounded_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(page_batches(False), PAGES_DDL)


def tiff_files(media: DataFrame) -> DataFrame:
    """As tiff_pages, but one row a file: its pages, of one width, follow one another."""
    bounded_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(page_batches(True), PAGES_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff_files(text_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pages.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
