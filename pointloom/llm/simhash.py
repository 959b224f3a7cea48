"""SimHash near-duplicates by multi-index hashing, and their connected components.

Fingerprints of 64 bits link at ``RADIUS`` = 2 or fewer differing bits. Cut in two segments of 32 bits,
two linked fingerprints differ by at most one bit in one segment; a wider radius takes more segments. Each distinct
fingerprint enters a table under all its segments, and looks up each segment's Hamming ball of radius one. A pair one bit apart in
a segment is looked up from the side whose bit is zero alone, so it is fetched once a segment. The whole
distance is checked inside the join. Exact copies and equal fingerprints are one entry each, so their
number doesn't count; ids and memberships are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import LOWER, UPPER, discard, map_arrow, table, unwrapped, wrapped, written

SHINGLE, SEED, RADIUS = 3, 42, 2
_AZ = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits; a bit is 1 if it is in over half of the shingles' hashes. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_AZ).split()  # bytes.split cuts at \x20 and \x09-\x0D alone
    if not words:
        return 0
    flat, ends, digest = b" ".join(words), [], xxhash.xxh64_intdigest
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        return digest(flat, SEED)
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), "<u8", len(starts))
    ones = np.zeros(64, "i8")
    for part in range(0, len(hashes), 1 << 16):  # keeps memory even for very long texts
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, fp): one row per row of ``docs`` (row, doc_id, text); fp is the signed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint_of(t.as_py()) for t in batch.column(2)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view("<i8"))], ["row", "doc_id", "fp"])

    return map_arrow(docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "row long, doc_id long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: so many that ``radius`` differing bits leave at most one in some segment."""
    n = max(2, -(-(radius + 1) // 2))
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(cut: list[tuple[int, int]], balls: bool) -> Column:
    """Each segment's value with the segment's number above bit 58; with ``balls``, also those with one zero bit set."""
    parts = []
    for i, (first, width) in enumerate(cut):
        low = f"(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L)"
        ball = f"concat(array({low}), transform(filter(sequence(0, {width - 1}), b -> getbit({low}, b) = 0), b -> {low} | shiftleft(1L, b)))"
        parts.append(f"transform({ball if balls else f'array({low})'}, v -> v | {i << 58}L)")
    return F.expr(f"concat({', '.join(parts)})")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): linked pairs of different fingerprints, a pair once or several times. ``distinct`` has column fp."""
    cut = segments(radius)
    held = distinct.select(F.explode(_keys(cut, False)).alias("key"), F.col("fp").alias("b"))
    asked = distinct.select(F.explode(_keys(cut, True)).alias("key"), F.col("fp").alias("a"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return asked.join(held, (asked.key == held.key) & near).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. Only nodes of ``pairs`` (a, b) appear.

    Alternates large-star and small-star steps, which end in stars after a number of rounds that grows with the logarithm
    of the largest component. Each round is written to the shared folder; so are the least neighbours, a table of its own,
    so that the join can split a hub's links over tasks. Nothing is gathered but a count.
    """
    stars = written(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("u < v").distinct()
        old, stars = stars, written(small, "stars")
        discard(old, least)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(row, doc_id, fp, root, component_id): root is the smallest fingerprint of the component, component_id its smallest doc_id.

    Components are told apart by root alone: ids may clash or be null.
    """
    known = written(fingerprints(docs), "fingerprints")
    distinct = written(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    member = components(links(distinct, radius))
    rooted = written(distinct.join(member, distinct.fp == member.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    discard(distinct)
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = written(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    return known.join(named, "fp").select("row", "doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows give repeated rows.
    A null id takes part but never names a component unless all its ids are null. An empty table gives
    an empty result. Texts are read whole, in bounded memory. Other columns are ignored.
    """
    found = grouped(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text): that with the smallest id, of several the first; null ids come last.

    Components are those of linked fingerprints, whatever the ids: rows of unlinked texts all stay, even if they share an
    id or have none. Null and wordless texts are one component, as are repeated rows. An empty table gives an empty
    result. Other columns come through. ``radius`` is how many bits may differ.
    """
    whole = written(wrapped(docs).withColumn("row", F.monotonically_increasing_id()), "numbered-docs")
    found = written(grouped(whole.select("row", F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text")), radius), "grouped")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select("least.row")
    others = written(found.select("row").join(first, "row", "left_anti"), "dropped")  # far fewer than those that stay
    discard(found)
    return unwrapped(whole.join(others, "row", "left_anti"), docs)


def op4_simhash_near_dedup(spark, sf_dir):
    """Fingerprints and components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
