"""Benchmark decontamination by a prefix-filtered set join: DataFrame functions only.

A window (``WINDOW`` consecutive item words, or a shorter item whole) is the set of its word shingles.
To contain it, a document must hold every one of them, so the needed prefix is a single shingle: each
window is looked up by its rarest. Rarity is counted over all documents. A looked-up place gives the
window's start; bounds on position and length discard places where it would stick out of the document;
then the document's words there are compared with the window's, word by word.

Documents' shingles that no window has are dropped before anything is exploded, by a bitmap that is set for every
benchmark shingle; what passes by chance is dropped by the joins. The bitmap has ``SPARSE`` bits for each shingle,
counted first, and ``BITMAP`` bits at most: a benchmark too large for that only lets more places pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import NON_WORD, az_lower, table, unwrapped, words_of, wrapped, written

WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap for each shingle, and at most (16 MB).
SPARSE, BITMAP = 32, 1 << 27


def words(text: Column) -> Column:
    """The contract's words of a text; none for null."""
    return words_of(az_lower(F.coalesce(text, F.lit(""))), NON_WORD)


def shingle(k: Column | int, w: str = "w", i: Column | None = None) -> Column:
    """Hash of the shingle of ``SHINGLE`` words at ``i``, or of one or two where the window has no more."""
    i = F.lit(0) if i is None else i
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, text, len, and shingles: their hash and offset); and (win, item_id) pairs."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    many = w.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))")).alias("text")).distinct()
    of = many.select("item_id", F.xxhash64("text").alias("win"), "text")
    items = written(of.select("win", "item_id").distinct(), "window-items")
    windows = of.select("win", "text").distinct().withColumn("len", F.size("text"))
    hashes = F.when(F.col("len") >= SHINGLE, F.transform(F.expr(f"sequence(0, greatest(len - {SHINGLE}, 0))"), lambda i: F.struct(shingle(3, "text", i).alias("h"), i.alias("at"))))
    for k in (2, 1):
        hashes = hashes.when(F.col("len") == k, F.array(F.struct(shingle(k, "text").alias("h"), F.lit(0).alias("at"))))
    return written(windows.withColumn("shingles", hashes), "windows"), items


def bitmap_of(windows: DataFrame) -> tuple[int, list[int]]:
    """How many bits there are, a power of two, and the bits as longs: one is set for each shingle hash's lowest bits."""
    n = windows.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    size = min(BITMAP, max(1 << 16, 1 << (SPARSE * n).bit_length()))
    rows = windows.select(F.explode("shingles.h").alias("h")).selectExpr(f"cast(pmod(h, {size}) div 64 as int) AS at", f"shiftleft(1L, cast(pmod(h, {size}) % 64 as int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = [0] * (size // 64)
    for r in rows.toArrow().to_pylist():  # at most BITMAP / 64 rows
        out[r["at"]] = r["bits"]
    return size, out


def shared(docs: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (with struct ``d``) and n_words, and ``found``: places of possible benchmark shingles.

    Each place has its hash and the words from ``size - 1`` before it to ``size - 1`` after it, ``back`` of them before.
    """
    lengths = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # at most 1, 2, 3
    size_of, bits = bitmap_of(windows)
    out = docs.withColumn("w", words(F.col("d.text"))).withColumn("n_words", F.size("w").cast("long"))
    if not lengths:
        return out.withColumn("found", F.expr("cast(array() as array<struct<k:int,p:int,h:bigint,back:int,near:array<string>>>)")).drop("w")
    spark = docs.sparkSession
    held = spark.createDataFrame([(bits,)], "bits array<long>")  # one row of at most BITMAP bits
    out = out.crossJoin(F.broadcast(held))
    parts = []
    for k in lengths:
        h = f"xxhash64({', '.join(f'get(w, i + {j})' for j in range(k))})"
        known = f"getbit(get(bits, cast(pmod({h}, {size_of}) div 64 as int)), cast(pmod({h}, {size_of}) % 64 as int)) = 1"
        places = f"filter(sequence(0, size(w) - {k}), i -> {known})"
        parts.append(f"if(size(w) >= {k}, transform({places}, i -> named_struct('k', {k}, 'p', i, 'h', {h}, 'back', least(i, {size - 1}), 'near', slice(w, greatest(i - {size - 1}, 0) + 1, least(i, {size - 1}) + {size}))), array())")
    return out.withColumn("found", F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0])).drop("w", "bits")


def occurrences(known: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, win, start, len): every place in a document where a window's words stand. ``known`` is written ``shared`` with row."""
    places = known.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    each = windows.select("win", "len", F.explode("shingles").alias("s")).select("win", "len", "s.h", "s.at")
    rarity = places.groupBy("h").agg(F.count("*").alias("n"))
    ranked = each.join(rarity, "h").groupBy("win").agg(F.count("*").alias("met"), F.max("len").alias("len"), F.min(F.struct("n", "h", "at")).alias("rarest"))
    needed = ranked.where(F.col("met") == F.greatest(F.col("len") - SHINGLE, F.lit(0)) + 1)  # a shingle that no document has rules its window out
    prefix = needed.select("win", F.col("rarest.h").alias("h"), F.col("rarest.at").alias("at")).join(windows.select("win", "text", "len"), "win")
    start, first = F.col("p") - F.col("at"), F.col("back") - F.col("at")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words")) & (F.col("k") == F.least("len", F.lit(SHINGLE)))
    same = F.slice("near", F.greatest(first, F.lit(0)) + 1, F.col("len")) == F.col("text")
    return places.join(prefix, "h").where(fits & same).select("row", "win", start.alias("start"), "len")


def hits_of(found: DataFrame) -> DataFrame:
    """(row, n_hit): words inside any occurrence, each counted once. One entry a place and row, never one a word."""
    longest = found.groupBy("row", "start").agg(F.max("len").alias("len"))
    spans = longest.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    union = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(a.to, x.start)), 'to', greatest(a.to, x.end)), a -> a.n)")
    return spans.select("row", union.alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without words have no windows and null item ids
    are left out of the items' list. Repeated rows give repeated rows; repeated items and windows count once.
    Empty tables give empty or hit-free results. Texts are read whole. Other columns are ignored.
    """
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    windows, items = windows_of(benchmark, size)
    base = docs.select(F.struct(F.col("text").cast("string").alias("text")).alias("d"), F.col("doc_id"), F.monotonically_increasing_id().alias("row"))
    known = written(shared(base, windows, size).drop("d"), "shared")
    found = written(occurrences(known, windows), "occurrences")
    ids = found.select("row", "win").distinct().join(items, "win").select("row", F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    named = ids.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = known.select("row", "doc_id", "n_words").join(hits_of(found), "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) without a hit, with their own columns.

    Null and empty texts have no words, so they stay, as do rows with null ids; repeated rows stay or go alike. Items without
    words hit nothing; repeated items count once. Empty documents give an empty result; an empty benchmark drops nothing.
    """
    windows, _ = windows_of(benchmark.select("item_id", F.col("text").cast("string").alias("text")), size)
    known = written(shared(wrapped(docs).withColumn("row", F.monotonically_increasing_id()), windows, size), "shared-docs")
    bad = written(occurrences(known.select("row", "n_words", "found"), windows).select("row").distinct(), "contaminated")
    return unwrapped(known.select("row", "d").join(bad, "row", "left_anti"), docs)


def op2_benchmark_decontamination(spark, sf_dir):
    """Every document against every benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
