"""PLY files (ascii, binary of either order): parsing with NumPy, a Spark data source, single-file writers.

``spark.read.format("ply")`` yields one row a vertex, ``format("ply_faces")`` one row a triangle. A vertex element of
scalar properties in a binary file is a fixed-size table, so its rows are split into byte ranges, one
task each; whatever else a file has is read by one task.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointloom.functions.formatting import general

#: Type names of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
POINT, NORMALS, COLORS = ("x", "y", "z"), ("nx", "ny", "nz"), ("red", "green", "blue")
CHUNK = 1 << 19


class PlyError(ValueError):
    """The file isn't a PLY file that can be read."""


@dataclass
class Property:
    name: str
    kind: str
    count_kind: str | None = None  # of a list


@dataclass
class Element:
    name: str
    count: int
    properties: list[Property] = field(default_factory=list)

    def has(self, name: str) -> bool:
        return any(p.name == name for p in self.properties)

    def plain(self) -> bool:
        return all(p.count_kind is None for p in self.properties)


@dataclass
class Header:
    form: str
    elements: list[Element]
    offset: int

    @property
    def order(self) -> str:
        return ">" if self.form == "binary_big_endian" else "<"

    def element(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.name == name), None)

    def row_type(self, e: Element) -> np.dtype:
        return np.dtype([(f"p{i}", self.order + p.kind) for i, p in enumerate(e.properties)])


def parse_header(data: bytes) -> Header:
    try:
        return _parse_header(data)
    except (IndexError, KeyError, ValueError) as e:
        raise PlyError(f"bad PLY header: {e}") from e


def _parse_header(data: bytes) -> Header:
    form, elements, at, first = None, [], 0, True
    while True:
        end = data.index(b"\n", at)
        line, at = data[at:end].decode("utf-8").rstrip("\r"), end + 1
        if first:
            if line.strip() != "ply":
                raise PlyError("no PLY file")
            first = False
            continue
        words = line.split()
        match words[:1]:
            case ["format"]:
                form = words[1]
                if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
                    raise PlyError(f"unknown format {form}")
            case ["element"]:
                elements.append(Element(words[1], int(words[2])))
                if elements[-1].count < 0:
                    raise PlyError("negative count")
            case ["property"]:
                spec = Property(words[4], TYPES[words[3]], TYPES[words[2]]) if words[1] == "list" else Property(words[2], TYPES[words[1]])
                elements[-1].properties.append(spec)
            case ["end_header"]:
                break
    if form is None:
        raise PlyError("no format line")
    return Header(form, elements, at)


def read_body(data: bytes, header: Header) -> dict[str, list]:
    """For each element the columns of its properties: arrays, or lists of arrays for list properties."""
    out: dict[str, list] = {}
    if header.form == "ascii":
        tokens, at = data[header.offset :].split(), 0
        for e in header.elements:
            if e.plain():
                n = e.count * len(e.properties)
                if at + n > len(tokens):
                    raise PlyError("truncated")
                table = np.array(tokens[at : at + n], dtype="S").astype("f8").reshape(e.count, len(e.properties))
                columns, at = list(table.T), at + n
            else:
                columns = [[] for _ in e.properties]
                for _ in range(e.count):
                    for column, p in zip(columns, e.properties, strict=True):
                        try:
                            n = int(tokens[at]) if p.count_kind else 1
                            at += p.count_kind is not None
                            if at + n > len(tokens):
                                raise PlyError("truncated")
                            values = [float(t) for t in tokens[at : at + n]]
                        except (IndexError, ValueError) as err:
                            raise PlyError("truncated or malformed") from err
                        at += n
                        column.append(values if p.count_kind else values[0])
            out.setdefault(e.name, columns)
        return out
    at = header.offset
    for e in header.elements:
        if e.plain():
            row = header.row_type(e)
            if at + e.count * row.itemsize > len(data):
                raise PlyError("truncated")
            table = np.frombuffer(data, row, e.count, at)
            columns, at = [table[f"p{i}"].astype("f8") for i in range(len(e.properties))], at + e.count * row.itemsize
        else:
            columns = [[] for _ in e.properties]
            kinds = [(np.dtype(header.order + p.count_kind) if p.count_kind else None, np.dtype(header.order + p.kind)) for p in e.properties]
            for _ in range(e.count):
                for column, (counter, kind) in zip(columns, kinds, strict=True):
                    try:
                        n = 1
                        if counter is not None:
                            n, at = int(np.frombuffer(data, counter, 1, at)[0]), at + counter.itemsize
                        values = np.frombuffer(data, kind, n, at).astype("f8")
                    except ValueError as err:
                        raise PlyError("truncated") from err
                    at += n * kind.itemsize
                    column.append(values.tolist() if counter is not None else float(values[0]))
        out.setdefault(e.name, columns)
    return out


def vertex_groups(e: Element) -> list[tuple[str, tuple[str, ...]]]:
    """The attribute groups that a vertex element has: a group is there if its first property is."""
    names = [("x", POINT), ("nx", NORMALS), ("red", COLORS)]
    return [(first, group) for first, group in names if e.has(first)]


def vertices_of(header: Header, columns: list) -> dict[str, np.ndarray]:
    e = header.element("vertex")
    out, at = {}, {p.name: i for i, p in reversed(list(enumerate(e.properties)))}
    for first, group in vertex_groups(e):
        for name, column in zip(group, {"x": "xyz", "nx": ("nx", "ny", "nz"), "red": "rgb"}[first], strict=True):
            values = np.asarray(columns[at[name]], "f8") if name in at else np.zeros(e.count)
            out[column] = values / 255.0 if first == "red" else values
    return out


def _within(p: np.ndarray, corners: np.ndarray) -> bool:
    """Even-odd test of a point against a polygon in the plane."""
    a, b = corners, np.roll(corners, -1, axis=0)
    crosses = ((a[:, 1] <= p[1]) & (b[:, 1] > p[1])) | ((b[:, 1] <= p[1]) & (a[:, 1] > p[1]))
    if not crosses.any():
        return False
    a, b = a[crosses], b[crosses]
    return bool(np.count_nonzero((b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] < p[0]) % 2)


def triangulate(points: np.ndarray, face: list[int]) -> list[tuple[int, int, int]]:
    """A polygon's triangles by clipping convex corners that hold no other corner, seen from above (x, y)."""
    if len(face) < 3 or min(face) < 0 or max(face) >= len(points):
        raise PlyError("face with too few or unknown vertices")
    left, out = list(face), []
    if len(left) > 3:
        ring = points[left]
        edges = np.roll(ring, -1, axis=0) - ring
        normal = np.cross(edges, np.roll(edges, -1, axis=0)).sum(0)
        if not 0 < np.linalg.norm(normal) < np.inf:
            raise PlyError("degenerate polygon")
    while len(left) > 3:
        for i in range(1, len(left) - 1):
            a, b, c = (points[left[i + k]] for k in (-1, 0, 1))
            if np.cross(b - a, c - b) @ normal <= 0:
                continue
            others = left[: i - 1] + left[i + 2 :]
            if not any(_within(points[o], np.array([a, b, c])[:, :2]) for o in others):
                out.append((left[i - 1], left[i], left[i + 1]))
                del left[i]
                break
        else:
            raise PlyError("polygon can't be cut into triangles")
    return [*out, tuple(left)]


def parse_points(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z and what there is of nx, ny, nz and r, g, b (in 0..1)."""
    header = parse_header(data)
    e = header.element("vertex")
    if e is None or not e.has("x") or not e.count:
        raise PlyError("no vertices")
    return vertices_of(header, read_body(data, header)["vertex"])


def parse_mesh(data: bytes) -> tuple[dict[str, np.ndarray], list[tuple[int, int, int]]]:
    """Vertex columns and triangles; polygons are cut into triangles, any bad face fails the whole file."""
    header = parse_header(data)
    e, f = header.element("vertex"), header.element("face")
    if e is None or not e.has("x") or not e.count:
        raise PlyError("no vertices")
    body = read_body(data, header)
    vertices = vertices_of(header, body["vertex"])
    points = np.stack([vertices[c] for c in "xyz"], 1)
    faces = []
    if f is not None:
        names = [p.name for p in f.properties]
        at = next((names.index(n) for n in ("vertex_indices", "vertex_index") if n in names), None)
        faces = body["face"][at] if at is not None else []
    triangles = []
    for face in faces:
        if not all(np.isfinite(v) and v >= 0 and v == int(v) for v in face):
            raise PlyError("face index that is no natural number")
        triangles += triangulate(points, [int(v) for v in face])
    return vertices, triangles


def _header(ascii: bool, n: int, normals: bool, colors: bool, faces: int | None = None) -> str:
    lines = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0", "comment Created by pointloom", f"element vertex {n}"]
    lines += [f"property double {c}" for c in (*"xyz", *(NORMALS if normals else ()))]
    lines += [f"property uchar {c}" for c in (COLORS if colors else ())]
    lines += [f"element face {faces}", "property list uchar uint vertex_indices"] if faces is not None else []
    return "\n".join([*lines, "end_header", ""])


def encode(columns: dict[str, np.ndarray], ascii: bool = False, triangles: np.ndarray | None = None) -> bytes:
    """The bytes of a file with these columns (x, y, z and perhaps nx .. and r ..) and triangles."""
    n, normals, colors = len(columns["x"]), "nx" in columns, "r" in columns
    numbers = [np.asarray(columns[c], "f8") for c in (*"xyz", *(NORMALS if normals else ()))]
    shades = [np.floor(np.clip(np.nan_to_num(np.asarray(columns[c], "f8"), nan=0.0), 0, 1) * 255 + 0.5).astype("u1") for c in ("rgb" if colors else "")]
    head = _header(ascii, n, normals, colors, None if triangles is None else len(triangles)).encode()
    if ascii:
        rows = [" ".join([*map(general, row[: len(numbers)]), *(str(int(v)) for v in row[len(numbers) :])]) for row in zip(*(c.tolist() for c in [*numbers, *shades]), strict=True)]
        rows += [] if triangles is None else [f"3 {a} {b} {c}" for a, b, c in triangles]
        return head + "".join(r + "\n" for r in rows).encode()
    table = np.empty(n, [(f"p{i}", "<f8" if i < len(numbers) else "u1") for i in range(len(numbers) + len(shades))])
    for i, c in enumerate([*numbers, *shades]):
        table[f"p{i}"] = c
    out = head + table.tobytes()
    if triangles is not None:
        faces = np.empty(len(triangles), [("n", "u1"), ("v", "<u4", 3)])
        faces["n"], faces["v"] = 3, np.asarray(triangles, "u4").reshape(-1, 3)
        out += faces.tobytes()
    return out


def _paths(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "*.ply")) if os.path.isdir(path) else glob.glob(path) or [path])


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int  # rows; all for -1

    def __init__(self, path: str, first: int = 0, count: int = -1):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, faces: bool, columns: list[str]):
        self.path, self.faces, self.columns = path, faces, columns

    def partitions(self) -> list[Part]:
        parts = []
        for path in _paths(self.path):
            with open(path, "rb") as f:
                header = parse_header(f.read(1 << 16))
            e = header.element("vertex")
            if self.faces or header.form == "ascii" or e is None or header.elements[0] is not e or not e.plain():
                parts.append(Part(path))
            else:
                parts += [Part(path, a, min(CHUNK, e.count - a)) for a in range(0, e.count, CHUNK)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if self.faces:
            with open(part.path, "rb") as f:
                _, triangles = parse_mesh(f.read())
            t = np.array(triangles, "i4").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(t), pa.string()), pa.array(np.arange(len(t)), pa.int64()), *map(pa.array, t.T.copy())], ["path", "tid", "v0", "v1", "v2"])
            return
        with open(part.path, "rb") as f:
            if part.count < 0:
                values = parse_points(f.read())
            else:
                header = parse_header(f.read(1 << 16))
                e = header.element("vertex")
                row = header.row_type(e)
                f.seek(header.offset + part.first * row.itemsize)
                table = np.frombuffer(f.read(part.count * row.itemsize), row)
                if len(table) < part.count:
                    raise PlyError("truncated")
                values = vertices_of(Header(header.form, [Element("vertex", part.count, e.properties)], 0), [table[f"p{i}"].astype("f8") for i in range(len(e.properties))])
        n = len(values["x"])
        arrays = [pa.array([part.path] * n, pa.string()), pa.array(np.arange(part.first, part.first + n), pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(values[c]) if c in values else pa.nulls(n, pa.float64()) for c in self.columns]], ["path", "pid", *self.columns])


class PlyVertices(DataSource):
    """One row a vertex: path, pid, x, y, z and the groups that the first file has."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _columns(self) -> list[str]:
        with open(_paths(self.options["path"])[0], "rb") as f:
            e = parse_header(f.read(1 << 16)).element("vertex")
        have = [first for first, _ in vertex_groups(e)] if e else []
        return [*"xyz", *(NORMALS if "nx" in have else ()), *("rgb" if "red" in have else "")]

    def schema(self) -> str:
        return "path string, pid long, " + ", ".join(f"{c} double" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], False, self._columns())


class PlyFaces(DataSource):
    """One row a triangle: path, tid, v0, v1, v2."""

    @classmethod
    def name(cls) -> str:
        return "ply_faces"

    def schema(self) -> str:
        return "path string, tid long, v0 int, v1 int, v2 int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], True, [])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of PLY files in any store that Spark reads, one file a task: path, pid, x, y, z and the first file's groups.

    The data source above reads folders that executors mount, and splits large files; this one goes through Spark's readers.
    A file that can't be read fails the query; of groups that only some files have, the others' rows are null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.select(F.substring("content", 1, 1 << 16).alias("head")).first()
    e = parse_header(bytes(first["head"])).element("vertex") if first else None
    have = [name for name, _ in vertex_groups(e)] if e else []
    columns = [*"xyz", *(NORMALS if "nx" in have else ()), *("rgb" if "red" in have else "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                values = parse_points(content.as_py())
                n = len(values["x"])
                arrays = [pa.array([name.as_py()] * n, pa.string()), pa.array(np.arange(n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(values[c]) if c in values else pa.nulls(n, pa.float64()) for c in columns]], ["path", "pid", *columns])

    return files.mapInArrow(run, "path string, pid long, " + ", ".join(f"{c} double" for c in columns))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlyVertices)
    spark.dataSource.register(PlyFaces)
