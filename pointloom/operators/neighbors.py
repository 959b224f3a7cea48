"""Neighbour search as joins. Results have qid, rank (from 1), nid, d2, by distance and then id.

* Radius search: a grid of cells a little wider than twice the radius turns the band join into an equi-join on cells, which
  Spark shuffles, spills and splits when skewed like any other. A query's ball lies in two cells along each axis, so it is sent to 8.
* Exact kNN without a radius: growing rings. Queries whose k-th neighbour lies within the ring are
  done; the others look again with twice the radius. The first radius is fitted to the densest places, so
  dense cells are left after few candidates, and only queries in sparse places see wide rings.
* Up to ``MOST_HELD`` targets, counted first, are held by every task (``Held``): queries stay where they are, and nothing is
  shuffled or sorted. Nearest points and hybrid search of more targets are growing rings that end at the radius.
* In many dimensions there is no grid: blocks of both sides meet, each pair of blocks in one task.

In every search, points with a NaN, infinite or null coordinate have no neighbours and are nobody's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vec import XYZ, norm2, sub, vec
from pointloom.plans.staging import written

BLOCK = 4096
#: Targets that every task may hold: 6 MB of coordinates, and as many a level of the grid.
MOST_HELD = 1 << 18


@dataclass(frozen=True)
class Knn:
    knn: int = 30


@dataclass(frozen=True)
class Radius:
    radius: float


@dataclass(frozen=True)
class Hybrid:
    radius: float
    max_nn: int


def finite(cloud: DataFrame, names: Sequence[str] = XYZ) -> DataFrame:
    return cloud.where(f"{' + '.join(f'abs({c})' for c in names)} < double('Infinity')")


def _queries(q: DataFrame) -> DataFrame:
    return q.select(F.col("qid"), *[F.col(c).cast("double").alias(f"q{c}") for c in XYZ])


def _targets(t: DataFrame) -> DataFrame:
    return t.select(F.col("pid").alias("nid"), *[F.col(c).cast("double").alias(c) for c in XYZ])


def _d2() -> Column:
    return norm2(sub(vec(["qx", "qy", "qz"]), vec()))


def ranked(pairs: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("d2", "nid")
    out = pairs.select("qid", "nid", "d2", F.row_number().over(order).cast("long").alias("rank"))
    return (out if most is None else out.where(F.col("rank") <= most)).select("qid", "rank", "nid", "d2")


def near_pairs(q: DataFrame, t: DataFrame, radius: float, carry: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(qid, nid, d2) of all pairs closer than ``radius`` (strictly).

    ``carry``: columns of ``t`` to take along, as t_name; then both points come too, as s_x .. and t_x ...
    ``by``: columns of both that must be equal, such as the number of a cloud.
    """
    # Expression strings: building the same columns one call at a time takes longer than running them on small clouds.
    width, reach = 2.004 * float(radius), 1.001 * float(radius)
    cells = lambda names, less, add: [f"floor(least(greatest(({n} - {less!r}D) / {width!r}D, -9e18D), 9e18D)){f' + {k}' if add else ''} AS c{i}" for i, (n, k) in enumerate(zip(names, "abc", strict=True))]
    asked = finite(q.selectExpr("qid", *by, *[f"cast({c} as double) AS q{c}" for c in XYZ]), ("qx", "qy", "qz"))
    held = finite(t.selectExpr("pid AS nid", *by, *[f"cast({c} as double) AS {c}" for c in XYZ], *[f"{c} AS t_{c}" for c in carry]))
    d2 = "(qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z) AS d2"
    points = [f"q{c} AS s_{c}" for c in XYZ] if carry else []
    for k in "abc":
        asked = asked.selectExpr("*", f"explode(array(0L, 1L)) AS {k}")
    asked = asked.selectExpr("qid", *by, "qx", "qy", "qz", *cells(("qx", "qy", "qz"), reach, True))
    both = asked.join(held.selectExpr("*", *cells(XYZ, 0.0, False)), [*by, "c0", "c1", "c2"])
    return both.selectExpr("qid", "nid", d2, *points, *[f"t_{c}" for c in carry]).where(f"d2 < {float(radius) ** 2!r}D")


class Held:
    """Points in the order of their ids, in grids of doubling widths that are made when they are asked for.

    Distances are those of ``near_pairs``, bit for bit. A ring of a width is trusted up to ``SURE`` of it, so that rounding in the
    cells loses nobody.
    """

    SURE, MOST, CANDIDATES = 0.999, 1 << 19, 1 << 20

    def __init__(self, points: np.ndarray, k: int, radius: float = np.inf):
        place = np.lexsort((np.arange(len(points)), *points.T))  # k at one place are enough
        same = np.concatenate([np.zeros(min(1, len(points)), bool), (np.diff(points[place], axis=0) == 0).all(1)])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(points))))
        self.at = np.sort(place[np.arange(len(points)) - first < k])
        self.points, self.k, self.radius = points[self.at], k, radius
        self.low, self.high = (f(self.points, 0) if len(points) else np.zeros(3) for f in (np.min, np.max))
        with np.errstate(over="ignore"):
            self.span = float(np.max(self.high - self.low))
        self.levels: dict[int, tuple] = {}
        least = self.span / self.MOST or 1.0
        self.width = max(least, radius / self.SURE * 1.001 if np.isfinite(radius) else self.span / max(1.0, round(len(self.points) ** (1 / 3))))
        while self.width / 2 > least and self.crowd() > max(2, k / 2):
            self.width /= 2

    def __getstate__(self) -> dict:
        return self.__dict__ | {"levels": {}}

    def cells(self, points: np.ndarray, width: float) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.clip(np.floor((points - self.low) / width), -2, self.MOST + 2).astype("i8")

    @staticmethod
    def key(c: np.ndarray, x: int = 0, y: int = 0, z: int = 0) -> np.ndarray:
        return (c[:, 0] + (x + 4) << 42) + (c[:, 1] + (y + 4) << 21) + (c[:, 2] + (z + 4))

    def crowd(self) -> float:
        """Points in a point's cell, on average over points."""
        n = np.unique(self.key(self.cells(self.points, self.width)), return_counts=True)[1].astype(float)
        return float((n * n).sum() / max(1.0, n.sum()))

    def level(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of cells in order, the points in them, and their places among all points."""
        if i not in self.levels:
            keys = self.key(self.cells(self.points, self.width * 2.0**i))
            order = np.argsort(keys, kind="stable")
            self.levels[i] = keys[order], self.points[order], self.at[order]
        return self.levels[i]

    def search(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, rank, place, d2) of the ``k`` nearest closer than ``radius``; each query's rows are together, in order."""
        left = np.flatnonzero(np.isfinite(q).all(1))
        if not len(left) or not len(self.points) or not self.radius > 0:
            return
        i = 0
        while len(left):
            width = self.width * 2.0**i
            whole = not width < min(2 * self.span, 1e150)  # the cells don't tell points apart: all are looked at
            last = whole or not width * self.SURE < self.radius
            if whole:
                points, at = self.points, self.at
                start, size = np.zeros((len(left), 1), "i8"), np.full((len(left), 1), len(points))
            else:
                keys, points, at = self.level(i)
                c = self.cells(q[left], width)
                ends = [(np.searchsorted(keys, self.key(c, x, y, -1)), np.searchsorted(keys, self.key(c, x, y, 1), "right")) for x in (-1, 0, 1) for y in (-1, 0, 1)]
                start, size = np.stack([a for a, _ in ends], 1), np.stack([b - a for a, b in ends], 1)
            total = np.cumsum(size.sum(1))
            again, a = [], 0
            while a < len(left):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.CANDIDATES)))
                n = size[a:b].ravel()
                met = np.repeat(start[a:b].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(np.arange(a, b), size[a:b].sum(1))
                with np.errstate(over="ignore"):
                    d = q[left[row]] - points[met]
                    d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
                if not (last and self.radius == np.inf):
                    near = d2 < (self.radius * self.radius if last else (width * self.SURE) ** 2)
                    met, row, d2 = met[near], row[near], d2[near]
                found = np.bincount(row - a, minlength=b - a)
                if not last:
                    done = found >= min(self.k, len(self.points))
                    again.append(left[a:b][~done])
                    of = done[row - a]
                    met, row, d2, found = met[of], row[of], d2[of], found * done
                where, begins = at[met], (np.cumsum(found) - found)[found > 0]
                if self.k == 1 and len(row):
                    least = np.minimum.reduceat(d2, begins)
                    ties = np.where(d2 == np.repeat(least, found[found > 0]), where, np.iinfo("i8").max)
                    yield left[row[begins]], np.ones(len(begins), "i8"), np.minimum.reduceat(ties, begins), least
                elif len(row):
                    order = np.lexsort((where, d2, row))
                    rank = np.arange(1, len(row) + 1) - np.repeat(begins, found[found > 0])
                    few = rank <= self.k
                    order = order[few]
                    yield left[row[order]], rank[few], where[order], d2[order]
                a = b
            left = np.concatenate(again) if again else left[:0]
            i += 1


def held_join(q: DataFrame, t: DataFrame, k: int, radius: float = np.inf, carry: Sequence[str] = ()) -> DataFrame | None:
    """(qid, rank, nid, d2) and the columns of ``near_pairs`` with ``carry``; None where ``t`` has more than ``MOST_HELD`` points,
    of each place's the ``k`` first.

    A written table of targets is gathered once for all searches of the same kind.
    """
    q = finite(q.selectExpr("qid", *[f"cast({c} as double) AS {c}" for c in XYZ]))
    t, kept = finite(t.selectExpr("pid", *[f"cast({c} as double) AS d{c}" for c in XYZ], *[f"{c} AS t_{c}" for c in carry]), ("dx", "dy", "dz")), t.__dict__
    kind, known = (k, radius, *carry), kept.get("_held", {})
    if kind not in known:
        if t.count() > MOST_HELD:  # of copies at one place, the k first are enough
            place = ["dx", "dy", "dz"]
            if t.agg(F.approx_count_distinct(F.struct(*place))).first()[0] > MOST_HELD:
                return None
            nth = F.row_number().over(Window.partitionBy(*place).orderBy("pid"))
            t = written(t.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"), "places")
            if t.count() > MOST_HELD:
                return None
        nested = dict(t.dtypes)["pid"].startswith(("struct", "array"))  # Arrow doesn't order these
        rows = (t.orderBy("pid") if nested else t).toArrow().combine_chunks()
        if not nested:
            rows = rows.take(pc.sort_indices(rows["pid"], null_placement="at_start"))
        held = Held(np.stack([rows[f"d{c}"].to_numpy() for c in XYZ], 1) if rows.num_rows else np.zeros((0, 3)), k, radius)
        known[kind] = q.sparkSession.sparkContext.broadcast((held, rows.drop_columns(["dx", "dy", "dz"])))
        if "_written_to" in kept:
            kept["_held"] = known
    shared = known[kind]
    schema = [("qid", dict(q.dtypes)["qid"]), ("rank", "bigint"), ("nid", dict(t.dtypes)["pid"]), ("d2", "double")]
    schema += [(f"s_{c}", "double") for c in XYZ if carry] + [(c, d) for c, d in t.dtypes if c.startswith("t_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = shared.value
        for batch in batches:
            points = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], 1)
            for asked, rank, at, d2 in held.search(points):
                own = rows.take(pa.array(at))
                moved = [pa.array(points[asked, i]) for i in range(3) if carry]
                out = [batch.column(0).take(pa.array(asked)), pa.array(rank), own["pid"].combine_chunks(), pa.array(d2), *moved]
                yield pa.RecordBatch.from_arrays([*out, *[own[c].combine_chunks() for c in own.column_names[1:]]], [n for n, _ in schema])

    return q.mapInArrow(run, ", ".join(f"`{n}` {d}" for n, d in schema))


def radius_join(q: DataFrame, t: DataFrame, radius: float) -> DataFrame:
    """All points of ``t`` (pid, x, y, z) closer than ``radius`` to each query of ``q`` (qid, x, y, z)."""
    if not radius > 0:
        return ranked(_queries(q).crossJoin(_targets(t).limit(0)).select("qid", "nid", _d2().alias("d2")))
    return ranked(near_pairs(q, t, radius))


def hybrid_join(q: DataFrame, t: DataFrame, radius: float, max_nn: int) -> DataFrame:
    """The ``max_nn`` nearest of those closer than ``radius``."""
    if not radius > 0:
        return radius_join(q, t, radius)
    if max_nn <= 0:
        return radius_join(q, t, 0)
    found = held_join(q, t, max_nn, radius)
    return rings(q, t, max_nn, radius) if found is None else found


def nearest_within(q: DataFrame, t: DataFrame, radius: float, carry: Sequence[str] = ()) -> DataFrame:
    """(qid, nid, d2) of the nearest point closer than ``radius``; ``carry`` as in ``near_pairs``."""
    if not radius > 0:
        return near_pairs(q, t.limit(0), 1.0, carry)
    found = held_join(q, t, 1, radius, carry)
    return (rings(q, t, 1, radius, carry=carry) if found is None else found).drop("rank")


def extent(cloud: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many points there are and the corners around them, in one job."""
    row = cloud.agg(F.count(F.lit(1)), *[f(c).cast("double") for f in (F.min, F.max) for c in XYZ]).first()
    corner = lambda values: np.array([0.0 if v is None else v for v in values])
    return row[0], corner(row[1:4]), corner(row[4:7])


#: Widths that one job looks at, each half of the one before.
LEVELS = 8


def first_radius(t: DataFrame, k: int, n: int, low: np.ndarray, high: np.ndarray) -> float:
    """The widest of halving cell widths at which the cell around a point holds about k points, averaged over points, so dense places decide.

    Points are counted by the narrowest cells; the wider ones are sums of those.
    """
    span = float(np.max(high - low)) or 1.0
    top = span / max(1.0, round(n ** (1 / 3)))
    for _ in range(3):
        least = top * 0.5 ** (LEVELS - 1)
        cells = t.selectExpr(*[f"floor(({c} - {float(o)!r}D) / {least!r}D) AS c{i}" for i, (c, o) in enumerate(zip(XYZ, low, strict=True))]).groupBy("c0", "c1", "c2").agg(F.count("*").alias("n"))
        wider = cells.selectExpr(f"explode(sequence(0, {LEVELS - 1})) AS level", "c0", "c1", "c2", "n").selectExpr("level", *[f"shiftright(c{i}, {LEVELS - 1} - level) AS c{i}" for i in range(3)], "n")
        sizes = wider.groupBy("level", "c0", "c1", "c2").agg(F.sum("n").cast("double").alias("n"))
        means = {r["level"]: r["mean"] for r in sizes.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
        for level in range(LEVELS):
            if means.get(level, 0.0) <= 2 * k:
                return top * 0.5**level
        top = least / 2
        if top < span * 1e-7:
            break
    return top


def knn_join(q: DataFrame, t: DataFrame, k: int, small: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest points of ``t`` to each query, itself included if it is there; of those with equal ``by`` columns.

    Tasks hold the targets if they are few enough; with ``small``, only for so many pairs, counted.
    """
    if k <= 0:
        return radius_join(q, t, 0)
    if not by and (small is None or small and q.count() * t.count() <= small):
        found = held_join(q, t, k)
        if found is not None:
            return found
    return rings(q, t, k, by=by)


def rings(q: DataFrame, t: DataFrame, k: int, most: float = np.inf, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest closer than ``most`` in growing rings, at any size."""
    q, t = finite(q), finite(t)
    (n_q, q_low, q_high), (n_t, low, high) = extent(q), extent(t)
    least = min(k, n_t)
    far = min(float(np.linalg.norm(np.maximum(high, q_high) - np.minimum(low, q_low))) * 1.001 + 1e-12, most)
    radius = first_radius(t, k, n_t, low, high)
    left, done = q.select("qid", *by, *XYZ), None
    met = Window.partitionBy("qid")
    while True:
        last = radius >= far
        pairs = near_pairs(left, t, min(radius, far), carry, by)
        rest = [c for c in pairs.columns if c not in ("qid", "nid", "d2")]
        nth = F.row_number().over(met.orderBy("d2", "nid")).cast("long")
        found = pairs.select("qid", nth.alias("rank"), "nid", "d2", *rest, F.count("*").over(met).alias("n")).where(F.col("rank") <= k)
        found = written(found if last else found.where(F.col("n") >= least), "ring")  # a query with too few looks again
        part = found.select("qid", "rank", "nid", "d2", *rest)
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        left = written(left.join(part.where("rank = 1").select("qid"), "qid", "left_anti"), "open-queries")
        if left.isEmpty():
            return done
        radius *= 2


def search(q: DataFrame, t: DataFrame, param: Knn | Radius | Hybrid) -> DataFrame:
    match param:
        case Knn(knn):
            return knn_join(q, t, knn)
        case Radius(radius):
            return radius_join(q, t, radius)
        case Hybrid(radius, max_nn):
            return hybrid_join(q, t, radius, max_nn)
    raise TypeError(f"not a search parameter: {param!r}")


def self_search(cloud: DataFrame, param: Knn | Radius | Hybrid) -> DataFrame:
    return search(cloud.withColumnRenamed("pid", "qid"), cloud, param)


def _top(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``k`` nearest rows of ``b`` to each row of ``a``, equal distances by id.

    A matrix product tells which rows can be among them, its rounding allowed for; their distances are summed from exact differences.
    """
    k = min(k, len(b))
    with np.errstate(over="ignore", invalid="ignore"):
        na, nb = (a * a).sum(1), (b * b).sum(1)
        size = na[:, None] + nb
        rough = size - 2 * (a @ b.T)
    if k and np.isfinite(rough).all():
        size *= 1e-15 * (a.shape[1] + 16)
        most = rough + size
        kth = most.min(1) if k == 1 else np.partition(most, k - 1, 1)[:, k - 1]
        row, col = np.nonzero(rough - size <= kth[:, None])
        d2 = np.zeros(len(row))
        for d in range(a.shape[1]):
            d2 += (a[row, d] - b[col, d]) ** 2
        order = np.lexsort((ids[col], d2, row))
        n = np.bincount(row, minlength=len(a))
        best = order[(np.cumsum(n) - n)[:, None] + np.arange(k)]
        return ids[col[best]], d2[best]
    d2 = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):  # exact differences: no cancellation, memory bounded by one plane
        d2 += (a[:, d, None] - b[None, :, d]) ** 2
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
    return ids[order], np.take_along_axis(d2, order, 1)


def _rows(asked: np.ndarray, near: np.ndarray, d2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, near.shape[1])), pa.array(near.ravel()), pa.array(d2.ravel())], ["qid", "nid", "d2"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Rows of a side that every task may hold, 64 numbers each being 64 MB; pairs of rows that a task looks at at once.
HELD, AT_ONCE = 1 << 17, 1 << 21


def feature_knn(q: DataFrame, t: DataFrame, k: int = 1, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """The ``k`` nearest of ``t`` (pid, feat) to each of ``q`` (qid, feat), in any number of dimensions.

    Where one side, counted first, has at most ``held`` rows, every task holds it, and the other stays where it is: a task
    has the nearest of its own rows, ``k`` for each query. Otherwise both sides are dealt into blocks by hash; each
    pair of blocks is one task, which keeps ``k`` rows a query.
    """
    q = q.select("qid", F.col("feat").cast("array<double>").alias("qf"))
    t = t.select(F.col("pid").alias("nid"), F.col("feat").cast("array<double>").alias("tf"))
    n_q, n_t = q.count(), t.count()
    if not n_q or not n_t:
        return ranked(q.crossJoin(t.limit(0)).select("qid", "nid", F.lit(0.0).alias("d2")), k)
    schema = f"qid {dict(q.dtypes)['qid']}, nid {dict(t.dtypes)['nid']}, d2 double"
    if min(n_q, n_t) <= held:
        small = (q if n_q < n_t else t).toArrow().combine_chunks()
        shared = q.sparkSession.sparkContext.broadcast((small.column(0).to_numpy(), _matrix(small.column(1).combine_chunks())))

        def of_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, b = shared.value
            for batch in batches:
                a, asked = _matrix(batch.column(1)), batch.column(0).to_numpy()
                step = max(1, AT_ONCE // len(b))
                for s in range(0, len(a), step):
                    yield _rows(asked[s : s + step], *_top(a[s : s + step], b, ids, k))

        def of_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, a = shared.value
            best: list = [(np.zeros((0, 0)),) * 2] * -(-len(a) // 256)
            for batch in batches:
                for s in range(0, batch.num_rows, block):
                    part = batch.slice(s, block)
                    b, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                    for i in range(len(best)):
                        near, d2 = _top(a[256 * i : 256 * i + 256], b, ids, k)
                        if best[i][0].size:
                            near, d2 = np.hstack([best[i][0], near]), np.hstack([best[i][1], d2])
                            order = np.lexsort((near, d2), axis=1)[:, :k]
                            near, d2 = np.take_along_axis(near, order, 1), np.take_along_axis(d2, order, 1)
                        best[i] = near, d2
            for i, (near, d2) in enumerate(best):
                if near.size:
                    yield _rows(asked[256 * i : 256 * i + 256], near, d2)

        return ranked(t.mapInArrow(of_targets, schema) if n_q < n_t else q.mapInArrow(of_queries, schema), k)
    blocks_q, blocks_t = -(-n_q // block), -(-n_t // block)
    qb = q.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(blocks_q))).withColumn("bt", F.explode(F.sequence(F.lit(0), F.lit(blocks_t - 1))))
    tb = t.withColumn("bt", F.pmod(F.xxhash64("nid"), F.lit(blocks_t)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_q - 1).cast("long"))))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "nid": [], "d2": []})
        a, b, ids, asked = np.stack(left["qf"]), np.stack(right["tf"]), right["nid"].to_numpy(), left["qid"].to_numpy()
        return pd.concat(_rows(asked[s : s + 256], *_top(a[s : s + 256], b, ids, k)).to_pandas() for s in range(0, len(a), 256))

    pairs = qb.groupBy("bq", "bt").cogroup(tb.groupBy("bq", "bt")).applyInPandas(nearest, schema)
    return ranked(pairs, k)


def rows_of(neighbours: DataFrame) -> Iterator:
    """The result on the driver, in order; for searches of a few points."""
    return iter(neighbours.orderBy("qid", "rank").collect())
