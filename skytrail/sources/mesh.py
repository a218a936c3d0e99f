"""Data sources "ply" and "obj": vertices of point clouds and meshes, and their writers."""

from __future__ import annotations

import fnmatch
import io
import struct
from collections.abc import Iterator
from glob import glob

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Scalar types of the PLY format and their struct codes.
PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}
ROWS = 200_000  # vertices a partition


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, local or with a scheme, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (arrow_fs.LocalFileSystem(), path)


def matching(pattern: str) -> list[str]:
    """The files that a pattern names, in order, on any file system that Arrow opens."""
    if ":" not in pattern.split("/")[0]:
        return sorted(glob(pattern, recursive=True))
    scheme, rest = pattern.split(":", 1)
    fixed = rest[: min((rest.find(c) for c in "*?[" if c in rest), default=len(rest))]
    system, base = _system(f"{scheme}:{fixed.rsplit('/', 1)[0] or '/'}")
    lead = len(fixed.rsplit("/", 1)[0]) - len(base)
    found = system.get_file_info(arrow_fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(f"{scheme}:{rest[:lead]}{f.path}" for f in found if f.is_file and fnmatch.fnmatch(rest[:lead] + f.path, rest))


def opened(path: str) -> io.BufferedIOBase:
    system, at = _system(path)
    return io.BufferedReader(system.open_input_file(at), 1 << 20)


class PlyHeader:
    """Format, elements (name, count, properties) and the length of the header."""

    def __init__(self, path: str):
        self.elements: list[tuple[str, int, list[tuple]]] = []
        with opened(path) as f:
            if f.readline().strip() != b"ply":
                raise ValueError(f"{path} is not a PLY file")
            while (line := f.readline().split()) and line[0] != b"end_header":
                word = [x.decode() for x in line]
                if word[0] == "format":
                    self.format = word[1]
                elif word[0] == "element":
                    self.elements.append((word[1], int(word[2]), []))
                elif word[0] == "property":
                    self.elements[-1][2].append((word[-1], *word[1:-1]))
            self.size = f.tell()
        self.order = ">" if self.format == "binary_big_endian" else "<"

    def element(self, name: str) -> tuple[int, int, list[tuple]] | None:
        """(elements before it, count, properties)"""
        for i, (n, count, props) in enumerate(self.elements):
            if n == name:
                return i, count, props
        return None

    def record(self, props: list[tuple]) -> struct.Struct:
        return struct.Struct(self.order + "".join(PLY_TYPES[p[1]] for p in props))


class Range(InputPartition):
    def __init__(self, path: str, block: int, start: int, stop: int):
        self.path, self.block, self.start, self.stop = path, block, start, stop


class PlyReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names

    def partitions(self) -> list[Range]:
        out = []
        first = None
        for block, path in enumerate(matching(self.path)):
            head = PlyHeader(path)
            kinds = head.element("vertex")[2] if head.element("vertex") else first
            if first is not None and kinds != first:
                raise ValueError(f"{path}: its vertices are not of the kind of the first file's")
            first = kinds
            n = head.element("vertex")[1] if head.element("vertex") else 0
            step = ROWS if head.format != "ascii" else max(n, 1)
            out += [Range(path, block, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        head = PlyHeader(part.path)
        place, _, props = head.element("vertex")
        if place:
            raise ValueError(f"{part.path}: vertices must be the first element")
        names = [p[0] for p in props]
        at = [names.index(c) if c in names else None for c in self.columns[2:]]
        with opened(part.path) as f:
            f.seek(head.size)
            if head.format == "ascii":
                rows = (tuple(map(float, f.readline().split())) for _ in range(part.stop))
            else:
                one = head.record(props)
                f.seek(part.start * one.size, 1)
                rows = one.iter_unpack(f.read((part.stop - part.start) * one.size))
            for i, row in enumerate(rows, part.start):
                yield (part.block, i, *(None if k is None else float(row[k]) for k in at))


class PlySource(DataSource):
    """Vertices (block, i, properties...) of the PLY files that a glob names; ranges are partitions."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        first = matching(self.options["path"])[:1]
        props = PlyHeader(first[0]).element("vertex")[2] if first else [("x",), ("y",), ("z",)]
        return "block int, i long, " + ", ".join(f"`{p[0]}` double" for p in props)

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options, schema)


def ply_faces(path: str) -> list[list[int]]:
    """Faces of a PLY file whose only other element is its vertices."""
    head = PlyHeader(path)
    face, vertex = head.element("face"), head.element("vertex")
    if face is None:
        return []
    out = []
    with opened(path) as f:
        f.seek(head.size)
        if head.format == "ascii":
            for _ in range(vertex[1]):
                f.readline()
            return [[int(x) for x in f.readline().split()[1:]] for _ in range(face[1])]
        f.seek(vertex[1] * head.record(vertex[2]).size, 1)
        count, item = (PLY_TYPES[x] for x in face[2][0][2:4])
        for _ in range(face[1]):
            n = struct.unpack(head.order + count, f.read(struct.calcsize(count)))[0]
            out.append(list(struct.unpack(f"{head.order}{n}{item}", f.read(n * struct.calcsize(item)))))
    return out


class ObjReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        return [Range(p, b, 0, 0) for b, p in enumerate(matching(self.path))]

    def read(self, part: Range) -> Iterator[tuple]:
        """Vertices, then faces as they come; a negative index counts back from the vertices so far."""
        seen = faces = 0
        with io.TextIOWrapper(opened(part.path), encoding="utf-8", errors="replace") as f:
            for line in f:
                word = line.split()
                if not word:
                    continue
                if word[0] == "v" and len(word) >= 4:
                    yield part.block, "v", seen, *map(float, word[1:4]), None
                    seen += 1
                elif word[0] == "f" and len(word) >= 4:
                    idx = [int(x.split("/")[0]) for x in word[1:]]
                    yield part.block, "f", faces, None, None, None, [k - 1 if k > 0 else seen + k for k in idx]
                    faces += 1


class ObjSource(DataSource):
    """Rows (block, kind v or f, i, x, y, z, idx) of the OBJ files that a glob names; indexes from 0,
    texture and normal references and faces of under three corners are left out."""

    @classmethod
    def name(cls) -> str:
        return "obj"

    def schema(self) -> str:
        return "block int, kind string, i long, x double, y double, z double, idx array<long>"

    def reader(self, schema: StructType) -> ObjReader:
        return ObjReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
    spark.dataSource.register(ObjSource)


def write_ply(spark: SparkSession, path: str, points: DataFrame, order: str, types: dict[str, str], faces: DataFrame | None = None, text: bool = False) -> None:
    """One PLY file of all the named columns (name: type of the format) of points in order, and of faces
    (face, idx), as text or little-endian binary.  Rows are packed on the executors and stream through
    the driver, a partition at a time."""
    import pyspark.sql.functions as F

    cols, codes = list(types), [np.dtype(PLY_TYPES[t]).newbyteorder("<") for t in types.values()]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros(b.num_rows, list(zip(cols, codes, strict=True)))
            for c, k in zip(cols, codes, strict=True):
                rows[c] = b.column(c).to_numpy(zero_copy_only=False).astype(k)
            if text:
                data = "".join(" ".join(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + "\n" for r in rows.tolist()).encode()
            else:
                data = rows.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    def packed_faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("idx").to_pylist()
            data = "".join(" ".join(map(str, (len(x), *x))) + "\n" for x in lists).encode() if text else b"".join(struct.pack(f"<B{len(x)}i", len(x), *x) for x in lists)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    head = ["ply", f"format {'ascii' if text else 'binary_little_endian'} 1.0", f"element vertex {points.count()}", *(f"property {t} {c}" for c, t in types.items())]
    parts = [points.orderBy(order).select(*[F.col(c) for c in cols]).mapInArrow(packed, "data binary")]
    if faces is not None:
        head += [f"element face {faces.count()}", "property list uchar int vertex_indices"]
        parts.append(faces.orderBy("face").select("idx").mapInArrow(packed_faces, "data binary"))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(("\n".join([*head, "end_header"]) + "\n").encode()))
        for part in parts:
            for r in part.toLocalIterator():
                out.write(bytearray(r.data))
    finally:
        out.close()


def ply_lines(points: DataFrame, order: str, text: bool = True) -> tuple[str, DataFrame]:
    """Header and body lines of an ASCII PLY of points (x, y, z and, if there, red, green, blue)."""
    from pyspark.sql import functions as F

    n = points.count()
    colour = [c for c in ("red", "green", "blue") if c in points.columns]
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in colour), "end_header"]
    body = F.concat_ws(" ", *[F.format_string("%.6f", F.col(c).cast("double")) for c in "xyz"], *[F.col(c).cast("int").cast("string") for c in colour])
    return "\n".join(head), points.orderBy(order).select(body.alias("value"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines of an OBJ: vertices in order, then faces, indexes from 1."""
    from pyspark.sql import functions as F

    v = vertices.select(F.lit(0).alias("k"), F.col("vertex").alias("n"), F.concat_ws(" ", F.lit("v"), *[F.format_string("%.6f", c) for c in "xyz"]).alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("face").alias("n"), F.concat(F.lit("f "), F.array_join(F.transform("idx", lambda i: (i + 1).cast("string")), " ")).alias("value"))
    return v.union(f).orderBy("k", "n").select("value")
