"""Files of the shared folder, from Python on driver and executors."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def uri_of(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's file systems resolve it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a URI and the path in it, for Python on any machine; None if it has none."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError):
        return None


def store(to: fs.FileSystem, path: str, data: bytes | BinaryIO) -> None:
    """One file of bytes or of an open file's, whole or not at all: under a name of its own first where files are local."""
    folder, name = path.rsplit("/", 1)
    local = to.type_name == "local"
    at = f"{folder}/.{uuid.uuid4().hex}" if local else path
    try:
        out = to.open_output_stream(at)
    except FileNotFoundError:
        to.create_dir(folder, recursive=True)
        out = to.open_output_stream(at)
    with out:
        if isinstance(data, bytes):
            out.write(data)
        else:
            shutil.copyfileobj(data, out, 1 << 20)
    if local:
        if os.path.exists(crc := f"{folder}/.{name}.crc"):
            os.remove(crc)  # of a file that Hadoop wrote there before
        os.replace(at, path)


def listed(here: fs.FileSystem, base: str, at: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what lies in a folder, without the checksums that Hadoop keeps beside local files."""
    found = here.get_file_info(fs.FileSelector(f"{base}{at}", allow_not_found=True))
    return [(f.base_name, f.type == fs.FileType.Directory) for f in found if not (f.base_name.startswith(".") and f.base_name.endswith(".crc"))]


def walked(here: fs.FileSystem, base: str, names: list[str]) -> Iterator[str]:
    """The paths from base of the files that are, or lie below, the named ones."""
    left = [(x, here.get_file_info(f"{base}/{x}").type == fs.FileType.Directory) for x in names]
    while left:
        at, folder = left.pop()
        if folder:
            left += [(f"{at}/{x}", sub) for x, sub in listed(here, base, f"/{at}")]
        else:
            yield at


def tops(spark: SparkSession, uri: str) -> DataFrame:
    """What lies in a folder itself, a row each, dealt to many tasks."""
    names = pd.DataFrame({"name": [name for name, _ in listed(*opened(uri), "")]}, dtype=object)
    return spark.createDataFrame(names, "name string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
