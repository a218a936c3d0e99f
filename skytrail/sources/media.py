"""PNG images, depth images, NPZ rollouts and mirrored files."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from skytrail.sources.files import children
from skytrail.sources.reach import opened, store, tops, uri_of, walked

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the PNG format
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: samples a pixel by colour type
PIXELS = 1 << 28  # larger images are an error


def encode_png(image: np.ndarray) -> bytes:
    """(height, width[, channels]) of uint8 or uint16 as an image without row filters."""
    image = image if image.ndim == 3 else image[..., None]
    h, w, c = image.shape
    kind = {n: k for k, n in CHANNELS.items()}[c]
    rows = image.astype(image.dtype.newbyteorder(">")).reshape(h, -1).view(np.uint8)
    body = zlib.compress(np.concatenate((np.zeros((h, 1), np.uint8), rows), axis=1).tobytes(), 6)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * image.itemsize, kind, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an image of 8 or 16 bits a sample, not interlaced; row filters are undone."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif name == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if head is None:
        raise ValueError("a PNG image without a header")
    w, h, bits, kind, _, _, interlaced = head
    if bits not in (8, 16) or kind not in CHANNELS or interlaced or w * h > PIXELS:
        raise ValueError("this kind of PNG image is not supported")
    c, size = CHANNELS[kind], bits // 8
    step, width = c * size, w * c * size
    raw = zlib.decompressobj().decompress(b"".join(parts), h * (width + 1))
    if len(raw) < h * (width + 1):
        raise ValueError("a PNG image is cut short")
    rows = np.frombuffer(raw, np.uint8, h * (width + 1)).reshape(h, width + 1)
    out = np.zeros((h + 1, width + step), np.uint8)  # a row and a pixel of zeros before the first
    for y in range(h):
        how, line, above, here = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if how == 0:
            here[step:] = line
        elif how == 1:
            here[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            here[step:] = line + above[step:]
        else:
            for i in range(width):
                a, b, d = int(here[i]), int(above[i + step]), int(above[i])
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                here[i + step] = (int(line[i]) + guess) & 255
    pixels = np.ascontiguousarray(out[1:, step:]).view(">u2" if size == 2 else np.uint8).reshape(h, w, c)
    return pixels.astype(np.uint16) if size == 2 else pixels


SHARES = 22  # fixed value: bits of a weight in 8-bit resampling


def _weights(old: int, new: int) -> np.ndarray:
    """(new, old): each new sample's share of the old ones by a triangle around its centre, as wide as the
    larger of both samples, in units of 2**-SHARES."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    lo = np.maximum(0, np.floor(centre - wide + 0.5)).astype(int)
    hi = np.minimum(old, np.floor(centre + wide + 0.5)).astype(int)
    x = np.arange(old)
    w = np.maximum(0.0, 1 - np.abs(x + 0.5 - centre[:, None]) / wide) * ((x >= lo[:, None]) & (x < hi[:, None]))
    return np.floor(w / w.sum(axis=1, keepdims=True) * (1 << SHARES) + 0.5).astype(np.int64)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, channels) of uint8 by bilinear resampling, along the rows first; larger images are averaged,
    not skipped over."""
    image = image if image.ndim == 3 else image[..., None]
    if image.dtype != np.uint8 or min(height, width, *image.shape) < 1:
        raise ValueError("resampling takes 8-bit images of at least one pixel")
    for axis, size in ((1, width), (0, height)):
        if image.shape[axis] != size:
            sums = np.tensordot(_weights(image.shape[axis], size), image.astype(np.int64), axes=(1, axis))
            image = np.moveaxis(np.clip((sums + (1 << SHARES - 1)) >> SHARES, 0, 255).astype(np.uint8), 0, axis)
    return image


def side_by_side(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two images of equal channels as one, both as high as the higher one."""
    high = max(left.shape[0], right.shape[0])
    return np.concatenate([resize(x, high, max(1, round(x.shape[1] * high / x.shape[0]))) for x in (left, right)], axis=1)


@F.pandas_udf(BinaryType())
def resized_png(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """A PNG of 8 bits a sample at another size; null for null, an error for what is no such image."""
    return pd.Series([None if d is None else encode_png(resize(decode_png(d), int(h), int(w))) for d, h, w in zip(data, height, width, strict=True)], dtype=object)


def depth_pixels(metres: np.ndarray) -> np.ndarray:
    """uint16 centimetres, truncated; 0 where there is no depth."""
    return np.clip(np.nan_to_num(np.asarray(metres, float) * 100.0, nan=0.0), 0, 65535).astype(np.uint16)


@F.pandas_udf(BinaryType())
def depth_png(metres: pd.Series, width: pd.Series) -> pd.Series:
    """PNG of centimetres from a row of metres by lines of `width`; null without samples."""
    return pd.Series([None if m is None or not len(m) else encode_png(depth_pixels(m).reshape(-1, int(w))) for m, w in zip(metres, width, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def rgb_png(samples: pd.Series, width: pd.Series) -> pd.Series:
    """PNG of red, green, blue values (0 to 255) by lines of `width` pixels."""
    return pd.Series([None if s is None or not len(s) else encode_png(np.asarray(s, np.uint8).reshape(-1, int(w), 3)) for s, w in zip(samples, width, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def black_ratio(content: pd.Series) -> pd.Series:
    """Share of pixels all of whose samples are 0 (a depth image: without depth); 0 without an image."""
    out = []
    for data in content:
        out.append(0.0 if data is None else float(np.mean((decode_png(bytes(data)) == 0).all(axis=2))))
    return pd.Series(out)


def rollout_files(frames: DataFrame, key: str, path: Column) -> DataFrame:
    """(path, content): an NPZ file for each rollout, of gt_xyzk and pred_xyzk as float32 in the order of
    frame_index; rows without a pose of one side do not count for it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        buf = io.BytesIO()
        pair = {n: pdf[cols].dropna().to_numpy(np.float32) for n, cols in (("gt_xyzk", ["x", "y", "z", "a"]), ("pred_xyzk", ["px", "py", "pz", "pa"]))}
        np.savez(buf, **pair)
        return pd.DataFrame({"path": [pdf["_path"].iloc[0]], "content": [buf.getvalue()]})

    return frames.withColumn("_path", path).groupBy(key).applyInPandas(run, "path string, content binary")


def write_files(df: DataFrame, root: str) -> None:
    """Writes (path, content) rows below a folder that executors share: small files, each by the task that
    has its row.  Where Python cannot reach the file system they go one at a time through the driver."""
    spark = df.sparkSession
    df, uri = df.select("path", "content"), uri_of(spark, root)
    if opened(uri) is None:
        conf = spark._jsc.hadoopConfiguration()
        for r in df.toLocalIterator():
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r.path}")
            out = p.getFileSystem(conf).create(p, True)
            try:
                out.write(bytearray(r.content))
            finally:
                out.close()
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = opened(uri)
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                if not (path.is_valid and content.is_valid):
                    raise ValueError(f"{path}: a file needs a path and content")
                store(to, f"{base}/{path.as_py()}", content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    df.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def mirror(spark: SparkSession, source: str, target: str, skip: tuple[str, ...] = (".parquet",)) -> list[str]:
    """Copies what lies below a folder to the same places below another, but for names with the endings
    to skip; files that are there stay.  The copied paths, by name.  What lies in the folder itself is
    listed by the driver, and each of it is walked and copied by a task."""
    uris = [uri_of(spark, p) for p in (source, target)]
    if any(opened(u) is None for u in uris):
        return mirror_by_driver(spark, source, target, skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, base), (there, to) = (opened(u) for u in uris)
        for b in batches:
            copied = []
            for at in walked(here, base, b.column(0).to_pylist()):
                if not at.endswith(skip) and there.get_file_info(f"{to}/{at}").type == fs.FileType.NotFound:
                    with here.open_input_stream(f"{base}/{at}") as f:
                        store(there, f"{to}/{at}", f)
                    copied.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(copied, pa.string())], names=["path"])

    return sorted(r.path for r in tops(spark, uris[0]).mapInArrow(run, "path string").collect())


def mirror_by_driver(spark: SparkSession, source: str, target: str, skip: tuple[str, ...]) -> list[str]:
    """mirror() one file at a time, for file systems that Python cannot reach."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    copied: list[str] = []

    def walk(below: str) -> None:
        for name, folder, _ in children(spark, f"{source}{below}"):
            at = f"{below}/{name}"
            if folder:
                walk(at)
            elif not name.endswith(skip):
                src, dst = path(f"{source}{at}"), path(f"{target}{at}")
                to = dst.getFileSystem(conf)
                if not to.exists(dst):
                    jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, to, dst, False, conf)
                    copied.append(at[1:])

    walk("")
    return sorted(copied)

