"""Datasets on file: episodes, JSON documents, rollouts, spreadsheets, discovery and manifests."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.functions import text
from skytrail.sources.reach import opened, tops, uri_of, walked

FRAME = "state array<float>, actions array<float>, env_id string, episode_index long, frame_index long, index long, task_index long"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, modified) of what lies in a folder, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(p))


def read_episodes(spark: SparkSession, path: str, schema: str = FRAME) -> DataFrame:
    """Frames of episode files, with episode_id from each file's name (the natural order of paths)."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "episode_*.parquet").parquet(path)
    return df.withColumn("episode_id", text.episode_id(F.col("_metadata.file_path")))


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """A missing file is an empty table, or with missing_ok=False an error."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """One small document, on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_rollouts(spark: SparkSession, path: str, name: str = "traj_gt_pred_xyzk.npz") -> DataFrame:
    """Frames of all rollout files below a folder, with task, split, env_id from their paths.

    Beyond the end of the shorter trajectory its columns are null.  An array that isn't (T, 4 or more)
    is an error.
    """
    task, split, env = text.rollout_path(F.col("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    files = files.select("path", "content", task.alias("task"), split.alias("split"), env.alias("env_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                data = np.load(io.BytesIO(r.content))
                gt, pred = (np.asarray(data[k], np.float32) for k in ("gt_xyzk", "pred_xyzk"))
                for a in (gt, pred):
                    if a.ndim != 2 or a.shape[1] < 4:
                        raise ValueError(f"{r.path}: expected (T, 4+), got {a.shape}")
                n = max(len(gt), len(pred))
                cols = {"path": r.path, "task": r.task, "split": r.split, "env_id": r.env_id, "frame_index": np.arange(n)}
                for a, names in ((gt, ("x", "y", "z", "a")), (pred, ("px", "py", "pz", "pa"))):
                    for i, c in enumerate(names):
                        cols[c] = pd.array([float(v) for v in a[:, i]] + [None] * (n - len(a)), dtype="Float64")
                yield pd.DataFrame(cols)

    schema = "path string, task string, split string, env_id string, frame_index long, x double, y double, z double, a double, px double, py double, pz double, pa double"
    return files.mapInPandas(run, schema)


def sheet_rows(content: bytes, sheet: int | str = 0) -> list[list]:
    """Cells of a worksheet of a spreadsheet package; numbers as floats, others as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        i = names.index(sheet) if isinstance(sheet, str) else sheet
        rows = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{i + 1}.xml")).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, object] = {}
            for c in row.findall("m:c", ns):
                col = 0
                for ch in re.match(r"[A-Z]*", c.get("r", "A"))[0]:
                    col = col * 26 + ord(ch) - 64
                v, kind = c.find("m:v", ns), c.get("t")
                if kind == "inlineStr":
                    cells[col - 1] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif v is not None:
                    cells[col - 1] = shared[int(v.text)] if kind == "s" else v.text if kind == "str" else float(v.text)
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return rows


def read_spreadsheets(spark: SparkSession, path: str, aliases: dict[str, list[str]], sheet: int | str = 0) -> DataFrame:
    """label, x, y, z of annotation sheets: each column is the first header found among its aliases
    (case and blanks ignored); rows whose coordinates aren't numbers, or without a label, go."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = sheet_rows(r.content, sheet)
                head = [str(h or "").strip().lower() for h in rows[0]] if rows else []
                at = {}
                for name, options in aliases.items():
                    found = [head.index(o.lower()) for o in options if o.lower() in head]
                    if not found:
                        raise ValueError(f"{r.path}: no column for {name}")
                    at[name] = found[0]
                cell = lambda row, name, at=at: row[at[name]] if at[name] < len(row) else None
                yield pd.DataFrame({"path": r.path} | {n: [None if (v := cell(row, n)) is None else str(v) for row in rows[1:]] for n in aliases})

    raw = files.mapInPandas(run, "path string, " + ", ".join(f"{n} string" for n in aliases))
    out = raw.select("path", *[F.trim(n).alias(n) if n == "label" else F.trim(n).try_cast("double").alias(n) for n in aliases])
    return out.dropna(subset=[n for n in aliases if n != "label"]).filter("label is not null and label <> ''")


def environments(spark: SparkSession, root: str, needs: list[str] = ("instruction.txt",), requested: list[str] | None = None) -> list[str]:
    """Folders below root that hold all the named files or folders, by name; of the requested ones, in
    the order of the request."""
    there = [n for n, folder, _ in children(spark, root) if folder and all(exists(spark, f"{root}/{n}/{x}") for x in needs)]
    return there if requested is None else [n for n in dict.fromkeys(requested) if n in there]


def only_present(episodes: DataFrame, present: list[str]) -> DataFrame:
    """The episodes of the scenes that are there."""
    return episodes.filter(F.col("env_id").isin(list(present)))


def snapshot(spark: SparkSession, root: str) -> set[str]:
    """The folders in a folder, to compare with a later look."""
    return {n for n, folder, _ in children(spark, root) if folder}


def appeared(spark: SparkSession, root: str, before: set[str]) -> str | None:
    """The newest of the folders that were not there before, or if there are none the newest of all."""
    found = [(t, n) for n, folder, t in children(spark, root) if folder]
    new = [x for x in found if x[1] not in before] or found
    return f"{root}/{max(new)[1]}" if new else None


def largest_numbered(spark: SparkSession, root: str) -> str | None:
    """The folder with the largest whole number for a name."""
    names = [n for n, folder, _ in children(spark, root) if folder and n.isdigit()]
    return f"{root}/{max(names, key=int)}" if names else None


def newest(spark: SparkSession, root: str) -> str | None:
    found = [(t, n) for n, folder, t in children(spark, root) if folder]
    return f"{root}/{max(found)[1]}" if found else None


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and SHA-256 of every file below a folder, but for hidden ones (. and _), as Spark's
    readers leave them out.  Tasks walk the folder's own entries."""
    uri = uri_of(spark, root)
    if opened(uri) is None:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return f.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = opened(uri)
        for b in batches:
            rows = []
            for at in walked(here, base, b.column(0).to_pylist()):
                if not any(part.startswith((".", "_")) for part in at.split("/")):
                    digest, size = hashlib.sha256(), 0
                    with here.open_input_stream(f"{base}/{at}") as f:
                        while data := f.read(1 << 20):
                            digest.update(data)
                            size += len(data)
                    rows.append((f"{uri}/{at}", size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "size_bytes", "sha256"])

    return tops(spark, uri).mapInArrow(run, "path string, size_bytes long, sha256 string")


def contents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of the files below a folder whose names match, but for hidden ones.  The driver lists
    the folder's own entries, and each task reads its share of them; patterns of folders go to Spark's reader."""
    uri = uri_of(spark, path) if isinstance(path, str) and not set(path) & set("*?[{") else None
    if uri is None or opened(uri) is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = opened(uri)
        batch = lambda paths, data: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], names=["path", "content"])
        paths, data, held = [], [], 0
        for b in batches:
            for at in walked(here, base, b.column(0).to_pylist()):
                if fnmatch.fnmatchcase(at.rsplit("/", 1)[-1], glob) and not any(part.startswith((".", "_")) for part in at.split("/")):
                    with here.open_input_stream(f"{base}/{at}") as f:
                        data.append(f.read())
                    paths.append(f"{uri}/{at}")
                    held += len(data[-1])
                    if len(paths) == 1000 or held > 8 << 20:
                        yield batch(paths, data)
                        paths, data, held = [], [], 0
        if paths:
            yield batch(paths, data)

    return tops(spark, uri).mapInArrow(run, "path string, content binary")


def image_size(content: F.Column) -> F.Column:
    """(width, height) of PNG bytes from their header; null for other formats."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(png, F.struct(number(17).alias("width"), number(21).alias("height")))


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, pose_id (the digits of the name), content and size; decoding is left to the caller."""
    f = contents(spark, path, glob)
    return f.select("path", F.regexp_extract("path", r"(\d+)[^/]*$", 1).try_cast("long").alias("pose_id"), "content", image_size(F.col("content")).alias("size"))
