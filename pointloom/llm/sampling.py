"""Learning samples: rows chosen by hash, counted into bags on the executors, bounded in rows and in entries.

A row's draw is a hash of its id and text, so repeated rows are one example, rows that only share an id are drawn apart,
and the sample depends neither on partitions nor on arrival order. Of each label the rows with the least draws are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import discard, map_arrow, written

RANGE = 1 << 40
#: Distinct rows are counted by a sketch with this error; the share of draws that is looked at has room for it.
ERROR = 0.02

Bag = tuple[np.ndarray, np.ndarray]


class Sample(NamedTuple):
    """In the order of (label, draw)."""

    labels: list
    draws: np.ndarray
    bags: list[list[Bag]]  # of each row, one or several


def draw_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(RANGE))


def share_for(wanted: int, n: int) -> int:
    """Draws below this are, but for a chance of about 1e-9, enough for ``wanted`` of ``n`` rows."""
    return RANGE if not n else min(RANGE, int(RANGE * (1 + 5 * ERROR) * (wanted + 8 * wanted**0.5 + 20) / n) + 1)


def below(limits: dict, strict: bool = True) -> Column:
    """Rows (label, draw) whose draw is below, or at, their label's limit."""
    of = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("label")]
    return F.col("draw") < of if strict else F.col("draw") <= of


def bags_of(rows: DataFrame, count: Callable[[Sequence[str], Sequence[int]], Sequence[Sequence[Bag]]]) -> DataFrame:
    """(label, draw, entries, buckets, counts), the lists one for each bag of a row; a task counts no row twice."""
    kind = dict(rows.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # never more than the sample
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            for start in range(0, len(new), 64):
                part = batch.take(pa.array(new[start : start + 64], pa.int64()))
                found = count(part.column(2).to_pylist(), part.column(1).to_pylist())
                lists = [pa.array([[b[k].astype("i4") for b in row] for row in found], pa.list_(pa.list_(pa.int32()))) for k in (0, 1)]
                entries = pa.array([sum(len(b[0]) for b in row) for row in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), entries, *lists], ["label", "draw", "entries", "buckets", "counts"])

    return map_arrow(rows.select("label", "draw", F.col("text").cast("string")), run, f"label {kind}, draw long, entries long, buckets array<array<int>>, counts array<array<int>>")


def cut(sizes: list[tuple], wanted: dict, most: int) -> dict:
    """Each label's largest draw: at most ``wanted`` rows and the label's part of ``most`` entries, one row at least."""
    share, limits, total, rows = most / max(1, sum(wanted.values())), {}, {}, {}
    for label, draw, entries in sorted(sizes):
        total[label], rows[label] = total.get(label, 0) + entries, rows.get(label, 0) + 1
        if label not in limits or (rows[label] <= wanted[label] and total[label] <= share * wanted[label]):
            limits[label] = draw
    return limits


def sample(rows: DataFrame, wanted: Callable[[dict], dict], most: int, count: Callable) -> Sample:
    """Bags of the sample of ``rows`` (label, draw, text; no nulls). ``wanted`` makes rows for each label of counts for each."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("draw", ERROR).alias("n")).collect()}
    if not counts:
        return Sample([], np.zeros(0, "i8"), [])
    most_rows = wanted(counts)
    bags = written(bags_of(rows.where(below({k: share_for(most_rows[k], n) for k, n in counts.items()})), count), "bags")
    sizes = bags.select("label", "draw", "entries").distinct().toArrow()
    limits = cut(list(zip(*(sizes[c].to_pylist() for c in ("label", "draw", "entries")), strict=True)), most_rows, most)
    if not limits:
        return Sample([], np.zeros(0, "i8"), [])
    got = bags.where(below(limits, strict=False)).dropDuplicates(["label", "draw"]).toArrow()
    discard(bags)
    labels, draws = got["label"].to_pylist(), got["draw"].to_numpy()
    order = sorted(range(len(labels)), key=lambda i: (labels[i], draws[i]))
    each = [[(b.values.to_numpy(), c.values.to_numpy()) for b, c in zip(bs.values, cs.values, strict=True)] for bs, cs in zip(got["buckets"], got["counts"], strict=True)]
    return Sample([labels[i] for i in order], draws[order], [each[i] for i in order])
