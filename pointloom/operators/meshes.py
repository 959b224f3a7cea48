"""Triangle meshes: vertices (vid, x, y, z, ...) and triangles (tid, v0, v1, v2, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vec import NORMAL, XYZ, cross, has, sub, vec, with_vec
from pointloom.operators.transforms import normalize_normals


def triangle_normals(vertices: DataFrame, triangles: DataFrame, normalized: bool = True) -> DataFrame:
    """``triangles`` with nx, ny, nz = (p1 - p0) x (p2 - p0); zero where an index has no vertex."""
    out = triangles.drop(*NORMAL)
    for i in range(3):
        corner = vertices.select(F.col("vid").cast("long").alias(f"_v{i}"), *[F.col(c).alias(f"_{c}{i}") for c in XYZ])
        out = out.join(corner, F.col(f"v{i}").cast("long") == F.col(f"_v{i}"), "left")
    p = [vec([f"_{c}{i}" for c in XYZ]) for i in range(3)]
    n = tuple(F.coalesce(x, F.lit(0.0)) for x in cross(sub(p[1], p[0]), sub(p[2], p[0])))
    out = with_vec(out, NORMAL, n).select(*triangles.drop(*NORMAL).columns, *NORMAL)
    return normalize_normals(out) if normalized else out


def vertex_normals(vertices: DataFrame, triangles: DataFrame, normalized: bool = True) -> DataFrame:
    """``vertices`` with nx, ny, nz: the sum of its triangles' normals, computed unless ``triangles`` has them."""
    faces = triangles if has(triangles, NORMAL) else triangle_normals(vertices, triangles, normalized=False)
    each = faces.select(F.explode(F.array(*[F.col(f"v{i}").cast("long") for i in range(3)])).alias("vid"), *NORMAL)
    sums = each.groupBy("vid").agg(*[F.sum(c).alias(c) for c in NORMAL])
    bare = vertices.drop(*NORMAL)
    out = bare.join(sums, bare.vid == sums.vid, "left").select(*[bare[c] for c in bare.columns], *[F.coalesce(sums[c], F.lit(0.0)).alias(c) for c in NORMAL])
    return normalize_normals(out) if normalized else out
