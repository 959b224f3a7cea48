"""Geometry classes over DataFrames.

Objects are immutable: methods return new objects. Arrays go in and come out by ``from_numpy`` and ``to_numpy``;
everything between is a lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from enum import IntEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import rotation as _rotation
from pointloom.functions.formatting import general
from pointloom.functions.rotation import *  # noqa: F403
from pointloom.functions.vec import COLOR, NORMAL, XYZ, has
from pointloom.operators import bounds as B
from pointloom.operators import meshes as M
from pointloom.operators import neighbors as N
from pointloom.operators import normals as NO
from pointloom.operators import transforms as T
from pointloom.operators import voxels as V


class GeometryType(IntEnum):
    Unspecified = 0
    PointCloud = 1
    VoxelGrid = 2
    TriangleMesh = 6
    AxisAlignedBoundingBox = 12


@dataclass(frozen=True)
class KDTreeSearchParamKNN:
    knn: int = 30

    def plan(self) -> N.Knn:
        return N.Knn(self.knn)

    def __repr__(self) -> str:
        return f"KDTreeSearchParamKNN(knn={self.knn})"


@dataclass(frozen=True)
class KDTreeSearchParamRadius:
    radius: float

    def plan(self) -> N.Radius:
        return N.Radius(self.radius)

    def __repr__(self) -> str:
        return f"KDTreeSearchParamRadius(radius={self.radius})"


@dataclass(frozen=True)
class KDTreeSearchParamHybrid:
    radius: float
    max_nn: int

    def plan(self) -> N.Hybrid:
        return N.Hybrid(self.radius, self.max_nn)

    def __repr__(self) -> str:
        return f"KDTreeSearchParamHybrid(radius={self.radius}, max_nn={self.max_nn})"


SearchParam = KDTreeSearchParamKNN | KDTreeSearchParamRadius | KDTreeSearchParamHybrid


def frame(spark: SparkSession, columns: dict[str, np.ndarray], key: str = "pid") -> DataFrame:
    """Rows from arrays of one length, numbered from 0."""
    n = len(next(iter(columns.values()), []))
    pdf = pd.DataFrame({key: np.arange(n, dtype="i8")} | {k: np.ascontiguousarray(v) for k, v in columns.items()})
    schema = f"{key} long, " + ", ".join(f"{k} {'int' if np.asarray(v).dtype.kind == 'i' else 'double'}" for k, v in columns.items())
    return spark.createDataFrame(pdf, schema)


def _xyz(points) -> np.ndarray:
    return np.asarray(points, float).reshape(-1, 3)


def _columns(df: DataFrame, names: Sequence[str], key: str) -> np.ndarray:
    return df.orderBy(key).select(*names).toPandas().to_numpy().reshape(-1, len(names)) if has(df, names) else np.zeros((0, len(names)))


class Geometry3D:
    """What clouds and meshes share: the maps and bounds of their points."""

    key, df = "pid", None

    def _with(self, df: DataFrame):
        return type(self)(df)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def dimension(self) -> int:
        return 3

    def get_min_bound(self) -> np.ndarray:
        return B.bounds_of(self.df)[0]

    def get_max_bound(self) -> np.ndarray:
        return B.bounds_of(self.df)[1]

    def get_center(self) -> np.ndarray:
        return B.center_of(self.df)

    def get_axis_aligned_bounding_box(self) -> AxisAlignedBoundingBox:
        return AxisAlignedBoundingBox.create_from_bounds(B.Box.of(self.df))

    def transform(self, transformation):
        return self._with(T.transform(self.df, transformation))

    def translate(self, translation, relative: bool = True):
        return self._with(T.translate(self.df, translation, relative))

    def scale(self, scale: float, center):
        return self._with(T.scale(self.df, scale, center))

    def rotate(self, R, center=None):
        return self._with(T.rotate(self.df, R, center))


for _name in (n for n in dir(_rotation) if n.startswith("get_rotation_matrix")):
    setattr(Geometry3D, _name, staticmethod(getattr(_rotation, _name)))


class PointCloud(Geometry3D):
    """Points with, perhaps, normals and colours: columns pid, x, y, z, nx, ny, nz, r, g, b."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def from_numpy(spark: SparkSession, points, normals=None, colors=None) -> PointCloud:
        columns = dict(zip(XYZ, _xyz(points).T, strict=True))
        for names, values in ((NORMAL, normals), (COLOR, colors)):
            columns |= {} if values is None or not len(values) else dict(zip(names, _xyz(values).T, strict=True))
        return PointCloud(frame(spark, columns))

    @property
    def points(self) -> np.ndarray:
        return _columns(self.df, XYZ, "pid")

    @property
    def normals(self) -> np.ndarray:
        return _columns(self.df, NORMAL, "pid")

    @property
    def colors(self) -> np.ndarray:
        return _columns(self.df, COLOR, "pid")

    def get_geometry_type(self) -> GeometryType:
        return GeometryType.PointCloud

    def has_points(self) -> bool:
        return not self.df.isEmpty()

    def has_normals(self) -> bool:
        return has(self.df, NORMAL) and self.has_points()

    def has_colors(self) -> bool:
        return has(self.df, COLOR) and self.has_points()

    def clear(self) -> PointCloud:
        return PointCloud(self.df.select("pid", *XYZ).limit(0))

    def normalize_normals(self) -> PointCloud:
        return PointCloud(T.normalize_normals(self.df)) if has(self.df, NORMAL) else self

    def paint_uniform_color(self, color) -> PointCloud:
        return PointCloud(T.paint_uniform_color(self.df, color))

    def voxel_down_sample(self, voxel_size: float) -> PointCloud:
        return PointCloud(V.down_sample(self.df, voxel_size))

    def estimate_normals(self, search_param: SearchParam = KDTreeSearchParamKNN(), fast_normal_computation: bool = True) -> PointCloud:
        return PointCloud(NO.estimate(self.df, search_param.plan(), fast_normal_computation))

    def orient_normals_to_align_with_direction(self, orientation_reference=(0.0, 0.0, 1.0)) -> PointCloud:
        return PointCloud(T.orient_to_direction(self.df, orientation_reference))

    def orient_normals_towards_camera_location(self, camera_location=(0.0, 0.0, 0.0)) -> PointCloud:
        return PointCloud(T.orient_to_camera(self.df, camera_location))

    def orient_normals_consistent_tangent_plane(self, k: int, lambda_penalty: float = 0.0, cos_alpha_tol: float = 1.0) -> PointCloud:
        return PointCloud(NO.orient_consistently(self.df, k, lambda_penalty, cos_alpha_tol))

    def remove_non_finite_points(self, remove_nan: bool = True, remove_infinite: bool = True) -> PointCloud:
        return PointCloud(T.remove_non_finite(self.df, remove_nan, remove_infinite))

    def crop(self, box: AxisAlignedBoundingBox) -> PointCloud:
        return PointCloud(self.df.where(B.inside(box.min_bound, box.max_bound)))

    def __repr__(self) -> str:
        return f"PointCloud with {self.df.count()} points."


class TriangleMesh(Geometry3D):
    """vertices (vid, x, y, z, ...) and triangles (tid, v0, v1, v2, ...)."""

    def __init__(self, vertices: DataFrame, triangles: DataFrame):
        self.df, self.triangle_df = vertices, triangles

    @staticmethod
    def from_numpy(spark: SparkSession, vertices, triangles) -> TriangleMesh:
        t = np.asarray(triangles, "i4").reshape(-1, 3)
        return TriangleMesh(frame(spark, dict(zip(XYZ, _xyz(vertices).T, strict=True)), "vid"), frame(spark, dict(zip(("v0", "v1", "v2"), t.T, strict=True)), "tid"))

    def _with(self, df: DataFrame) -> TriangleMesh:
        return TriangleMesh(df, self.triangle_df)

    @property
    def vertices(self) -> np.ndarray:
        return _columns(self.df, XYZ, "vid")

    @property
    def triangles(self) -> np.ndarray:
        return _columns(self.triangle_df, ("v0", "v1", "v2"), "tid")

    @property
    def vertex_normals(self) -> np.ndarray:
        return _columns(self.df, NORMAL, "vid")

    @property
    def vertex_colors(self) -> np.ndarray:
        return _columns(self.df, COLOR, "vid")

    @property
    def triangle_normals(self) -> np.ndarray:
        return _columns(self.triangle_df, NORMAL, "tid")

    def get_geometry_type(self) -> GeometryType:
        return GeometryType.TriangleMesh

    def has_vertices(self) -> bool:
        return not self.df.isEmpty()

    def has_triangles(self) -> bool:
        return self.has_vertices() and not self.triangle_df.isEmpty()

    def has_vertex_normals(self) -> bool:
        return has(self.df, NORMAL) and self.has_vertices()

    def has_vertex_colors(self) -> bool:
        return has(self.df, COLOR) and self.has_vertices()

    def has_triangle_normals(self) -> bool:
        return has(self.triangle_df, NORMAL) and self.has_triangles()

    def clear(self) -> TriangleMesh:
        return TriangleMesh(self.df.select("vid", *XYZ).limit(0), self.triangle_df.select("tid", "v0", "v1", "v2").limit(0))

    def transform(self, transformation) -> TriangleMesh:
        faces = T.transform_normals(self.triangle_df, transformation) if has(self.triangle_df, NORMAL) else self.triangle_df
        return TriangleMesh(T.transform(self.df, transformation), faces)

    def rotate(self, R, center=None) -> TriangleMesh:
        turn = T.with_vec(self.triangle_df, NORMAL, T.mat_vec(R, T.vec(NORMAL))) if has(self.triangle_df, NORMAL) else self.triangle_df
        return TriangleMesh(T.rotate(self.df, R, center), turn)

    def normalize_normals(self) -> TriangleMesh:
        vertices, faces = (T.normalize_normals(d) if has(d, NORMAL) else d for d in (self.df, self.triangle_df))
        return TriangleMesh(vertices, faces)

    def paint_uniform_color(self, color) -> TriangleMesh:
        """Without clamping."""
        return self._with(T.paint_uniform_color(self.df, color, clamp=False))

    def compute_triangle_normals(self, normalized: bool = True) -> TriangleMesh:
        out = TriangleMesh(self.df, M.triangle_normals(self.df, self.triangle_df, normalized=False))
        return out.normalize_normals() if normalized else out

    def compute_vertex_normals(self, normalized: bool = True) -> TriangleMesh:
        faces = self if has(self.triangle_df, NORMAL) else self.compute_triangle_normals(False)
        out = TriangleMesh(M.vertex_normals(self.df, faces.triangle_df, normalized=False), faces.triangle_df)
        return out.normalize_normals() if normalized else out

    def __repr__(self) -> str:
        return f"TriangleMesh with {self.df.count()} vertices and {self.triangle_df.count()} triangles."


@dataclass(frozen=True, repr=False)
class Voxel:
    grid_index: tuple[int, int, int] = (0, 0, 0)
    color: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __repr__(self) -> str:
        return f"Voxel(grid_index={' '.join(map(str, self.grid_index))}, color={' '.join(map(general, self.color))})"


def _is_translation(m: np.ndarray) -> bool:
    return bool(np.abs(m[:3, :3] - np.eye(3)).max() <= 1e-12 and np.abs(m[3] - [0, 0, 0, 1]).max() <= 1e-12)


@dataclass(frozen=True)
class VoxelGrid:
    """Occupied voxels (vx, vy, vz) of a grid; moving it moves the origin alone."""

    df: DataFrame
    origin: np.ndarray
    voxel_size: float

    @staticmethod
    def create_from_point_cloud(cloud: PointCloud, voxel_size: float) -> VoxelGrid:
        return VoxelGrid(*V.grid_of(cloud.df, voxel_size), voxel_size)

    @staticmethod
    def create_from_point_cloud_within_bounds(cloud: PointCloud, voxel_size: float, min_bound, max_bound) -> VoxelGrid:
        return VoxelGrid(V.occupied(cloud.df, voxel_size, min_bound, max_bound), np.asarray(min_bound, float), voxel_size)

    def get_voxels(self) -> list[Voxel]:
        return [Voxel(tuple(r), (0.5, 0.5, 0.5)) for r in self.df.orderBy(*V.VOXEL).collect()]

    def has_voxels(self) -> bool:
        return not self.df.isEmpty()

    def has_colors(self) -> bool:
        return True

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def clear(self) -> VoxelGrid:
        return VoxelGrid(self.df.limit(0), np.zeros(3), 0.0)

    def get_geometry_type(self) -> GeometryType:
        return GeometryType.VoxelGrid

    def get_min_bound(self) -> np.ndarray:
        return np.array(V.grid_bounds(self.df, self.origin, self.voxel_size).first()[:3])

    def get_max_bound(self) -> np.ndarray:
        return np.array(V.grid_bounds(self.df, self.origin, self.voxel_size).first()[3:])

    def get_center(self) -> np.ndarray:
        return np.array(V.grid_center(self.df, self.origin, self.voxel_size).first())

    def get_axis_aligned_bounding_box(self) -> AxisAlignedBoundingBox:
        return AxisAlignedBoundingBox(self.get_min_bound(), self.get_max_bound())

    def translate(self, translation, relative: bool = True) -> VoxelGrid:
        """Not relative: the origin itself goes there."""
        t = np.asarray(translation, float)
        return replace(self, origin=self.origin + t if relative else t)

    def scale(self, scale: float, center) -> VoxelGrid:
        c = np.asarray(center, float)
        return replace(self, origin=c + scale * (self.origin - c), voxel_size=self.voxel_size * scale)

    def transform(self, transformation) -> VoxelGrid:
        m = np.asarray(transformation, float)
        if not _is_translation(m):
            raise RuntimeError("VoxelGrid supports identity and translation only")
        return self.translate(m[:3, 3])

    def rotate(self, R, center=None) -> VoxelGrid:
        if np.abs(np.asarray(R, float) - np.eye(3)).max() > 1e-12:
            raise RuntimeError("VoxelGrid supports the identity rotation only")
        return self

    def __repr__(self) -> str:
        return f"VoxelGrid with {self.df.count()} voxels."


class AxisAlignedBoundingBox(B.Box):
    """An axis-aligned box; the operators' box with the geometry interface."""

    @staticmethod
    def create_from_bounds(box: B.Box) -> AxisAlignedBoundingBox:
        return AxisAlignedBoundingBox(box.min_bound, box.max_bound, box.color)

    @staticmethod
    def create_from_points(points) -> AxisAlignedBoundingBox:
        return AxisAlignedBoundingBox.create_from_bounds(B.Box.of_points(points))

    def get_geometry_type(self) -> GeometryType:
        return GeometryType.AxisAlignedBoundingBox

    def get_center(self) -> np.ndarray:
        return self.center()

    def get_extent(self) -> np.ndarray:
        return self.extent()

    def get_half_extent(self) -> np.ndarray:
        return self.extent() * 0.5

    def get_max_extent(self) -> float:
        return float(self.extent().max())

    def get_min_bound(self) -> np.ndarray:
        return self.min_bound

    def get_max_bound(self) -> np.ndarray:
        return self.max_bound

    def get_box_points(self) -> np.ndarray:
        return self.corners()

    def get_axis_aligned_bounding_box(self) -> AxisAlignedBoundingBox:
        return self

    def get_print_info(self) -> str:
        return self.print_info()

    def get_point_indices_within_bounding_box(self, points) -> list[int] | DataFrame:
        """Of an array, the indices inside; of a cloud, a table of their pids."""
        if isinstance(points, PointCloud):
            return points.df.where(B.inside(self.min_bound, self.max_bound)).select("pid")
        p = _xyz(points)
        return np.flatnonzero(((p >= self.min_bound - 1e-9) & (p <= self.max_bound + 1e-9)).all(1)).tolist()

    def translate(self, translation, relative: bool = True) -> AxisAlignedBoundingBox:
        return self.create_from_bounds(self.translated(translation, relative))

    def scale(self, scale: float, center) -> AxisAlignedBoundingBox:
        return self.create_from_bounds(self.scaled(scale, center))

    def transform(self, transformation):
        raise RuntimeError("A general transform of an AxisAlignedBoundingBox would not be axis aligned anymore.")

    def rotate(self, R, center=None):
        raise RuntimeError("A rotation of an AxisAlignedBoundingBox would not be axis aligned anymore.")

    def __add__(self, other: B.Box) -> AxisAlignedBoundingBox:
        return self.create_from_bounds(self.merged(other))

    def __repr__(self) -> str:
        a, b = (", ".join(map(general, x)) for x in (self.min_bound, self.max_bound))
        return f"AxisAlignedBoundingBox: min: ({a}), max: ({b})"


class KDTreeFlann:
    """Searches over a cloud or over features. There is no tree: each search is a join, best asked for many queries at once."""

    def __init__(self, data: PointCloud | DataFrame | None = None):
        self.df: DataFrame | None = None
        if data is not None:
            self.set_geometry(data)

    def set_geometry(self, data: PointCloud | DataFrame) -> bool:
        """A cloud, or a table (pid, x, y, z) or (pid, feat); false for an empty one."""
        self.df = data.df if isinstance(data, PointCloud) else data
        return not self.df.isEmpty()

    set_feature = set_geometry

    def set_matrix_data(self, spark: SparkSession, data) -> bool:
        """A matrix with one column a point."""
        columns = np.asarray(data, float).T
        self.df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(columns)], "pid long, feat array<double>")
        return len(columns) > 0

    def search(self, queries: DataFrame, param: SearchParam) -> DataFrame:
        """(qid, rank, nid, d2) for a table of queries (qid, x, y, z)."""
        return N.search(queries, self.df, param.plan())

    def _one(self, found: DataFrame) -> tuple[int, list[int], list[float]]:
        rows = found.orderBy("rank").collect()
        return len(rows), [r.nid for r in rows], [r.d2 for r in rows]

    def search_vector_3d(self, query, search_param: SearchParam) -> tuple[int, list[int], list[float]]:
        q = np.asarray(query, float)
        knn = getattr(search_param, "knn", getattr(search_param, "max_nn", 0))
        if self.df is None or q.shape != (3,) or knn < 0 or self.df.isEmpty():
            return -1, [], []
        asked = self.df.sparkSession.createDataFrame([(0, *map(float, q))], "qid long, x double, y double, z double")
        return self._one(self.search(asked, search_param))

    def search_knn_vector_3d(self, query, knn: int):
        return self.search_vector_3d(query, KDTreeSearchParamKNN(knn))

    def search_radius_vector_3d(self, query, radius: float):
        return self.search_vector_3d(query, KDTreeSearchParamRadius(radius))

    def search_hybrid_vector_3d(self, query, radius: float, max_nn: int):
        return self.search_vector_3d(query, KDTreeSearchParamHybrid(radius, max_nn))

    def search_vector_xd(self, query, search_param: SearchParam) -> tuple[int, list[int], list[float]]:
        if self.df is None or self.df.isEmpty():
            return -1, [], []
        if "feat" not in self.df.columns:
            return self.search_vector_3d(query, search_param)
        p = search_param.plan()
        k = p.knn if isinstance(p, N.Knn) else p.max_nn if isinstance(p, N.Hybrid) else self.df.count()
        if k < 0 or len(query) != len(self.df.first()["feat"]):
            return -1, [], []
        asked = self.df.sparkSession.createDataFrame([(0, [float(v) for v in query])], "qid long, feat array<double>")
        found = N.feature_knn(asked, self.df, k)
        return self._one(found if isinstance(p, N.Knn) else found.where(F.col("d2") < p.radius**2))

    def search_knn_vector_xd(self, query, knn: int):
        return self.search_vector_xd(query, KDTreeSearchParamKNN(knn))

    def search_radius_vector_xd(self, query, radius: float):
        return self.search_vector_xd(query, KDTreeSearchParamRadius(radius))

    def search_hybrid_vector_xd(self, query, radius: float, max_nn: int):
        return self.search_vector_xd(query, KDTreeSearchParamHybrid(radius, max_nn))
