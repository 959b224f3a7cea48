"""Removal of runs of lines that stand earlier in the corpus, by winnowing over line hashes.

Lengths are counted in words, so that one long line counts as much as many short ones; lines without words are passed over:

* a gram is the shortest run of lines from a line on that has ``GRAM`` words;
* a window is the shortest run of lines from a line on that has ``RUN`` words. Of the grams within it, that with the least
  hash (the last of equals) is its minimum. A document gives its distinct minima alone: neighbouring windows
  mostly share one. Both places of a repeated run of ``RUN`` words hold the same minimum, so nothing is missed;
* minima that the corpus has once are dropped. The others, joined by hash, are the places of possible matches;
* such a place is extended in both directions over the line hashes: to the left up to every line whose window chose
  it, to the right up to the window's end, and up to each later line that has ``RUN`` words behind it from that start on.
  The extended runs are compared by 128 bits, each with the first place that has it. Comparing with the first
  place of the minimum alone would not do: a later place can share more lines with the second than with the first;
* runs found again extend each other: overlapping ones of a document are merged, and deleted. The first place stays.

So a line with words goes exactly if it lies in a run of ``RUN`` words or more that stands at an earlier place; a line
without words goes if it lies within a compared run that goes. Places are ordered by (doc_id, text hash, line). Hot
lines make no pairs: each place meets the first one.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import discard, map_arrow, table, unwrapped, wrapped, written

RUN, GRAM = 50, 25
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lines_of(text: str) -> tuple[list[int], list[int], bytes]:
    """Of the lines with words: their numbers, how many words each has, and 16 bytes of hash each, put together."""
    numbers, sizes, digests = [], [], []
    for i, line in enumerate(text.split("\n")):
        words = [w for w in _SPACE.split(line) if w]
        if words:
            numbers.append(i)
            sizes.append(len(words))
            digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
    return numbers, sizes, b"".join(digests)


def _ends(sizes: list[int], least: int) -> list[int]:
    """For each line the end of the shortest run from it with ``least`` words, as far as the text has as many."""
    out, end, total = [], 0, 0
    for n in sizes:
        while total < least and end < len(sizes):
            total += sizes[end]
            end += 1
        if total < least:
            break
        out.append(end)
        total -= n
    return out


def minima_of(sizes: list[int], digests: bytes, run: int = RUN, gram: int = GRAM) -> tuple[list[int], list[int], list[int]]:
    """The windows' ends, the line at which each one's minimum begins, and the grams' hashes: linear in the lines."""
    ends = _ends(sizes, run)
    if not ends:
        return [], [], []
    gram_ends = _ends(sizes, gram)
    prints = [xxhash.xxh3_64_intdigest(digests[16 * i : 16 * e]) - (1 << 63) for i, e in enumerate(gram_ends)]
    chosen, waiting, k = [], deque(), 0
    for i, end in enumerate(ends):
        while k < len(gram_ends) and gram_ends[k] <= end:
            while waiting and prints[waiting[-1]] >= prints[k]:
                waiting.pop()
            waiting.append(k)
            k += 1
        while waiting[0] < i:
            waiting.popleft()
        chosen.append(waiting[0])
    return ends, chosen, prints


def runs_around(sizes: list[int], digests: bytes, places: set[int], run: int = RUN, gram: int = GRAM) -> list[tuple[int, int]]:
    """(first line, end) of the runs that extend the minima at ``places``: from each line on, and up to each line."""
    ends, chosen, _ = minima_of(sizes, digests, run, gram)
    spans = [(i, end) for i, end in enumerate(ends) if chosen[i] in places]
    upto = ((len(sizes) - end, len(sizes) - i) for i, end in enumerate(_ends(sizes[::-1], run)))
    return spans + [(i, end) for i, end in upto if ends[i] != end and chosen[i] in places]


def hashed(docs: DataFrame, run: int, gram: int) -> DataFrame:
    """(row, doc_id, text_hash, numbers, sizes, digests, minima) of ``docs`` (row, doc_id, text_hash, text) that have a window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(3)):
                numbers, sizes, digests = lines_of(text.as_py() or "")
                _, chosen, prints = minima_of(sizes, digests, run, gram)
                if chosen:
                    at.append(i)
                    out.append((numbers, sizes, digests, [{"at": k, "fingerprint": prints[k]} for k in sorted(set(chosen))]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            ints, minima = pa.list_(pa.int32()), pa.list_(pa.struct([("at", pa.int32()), ("fingerprint", pa.int64())]))
            lists = [pa.array(c, k) for c, k in zip(columns, (ints, ints, pa.binary(), minima), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)), *lists], ["row", "doc_id", "text_hash", "numbers", "sizes", "digests", "minima"])

    return map_arrow(docs.select("row", "doc_id", "text_hash", "text"), each, "row long, doc_id long, text_hash long, numbers array<int>, sizes array<int>, digests binary, minima array<struct<at:int,fingerprint:long>>")


def extended(lines: DataFrame, run: int, gram: int) -> DataFrame:
    """(row, doc_id, text_hash, h1, h2, start, end) of ``lines`` (hashed, with ``places``): hashes and line numbers of the runs around them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                at, got = [], []
                for i, (numbers, sizes, digests, places) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True)):
                    for a, b in runs_around(sizes, digests, set(places), run, gram):
                        h = xxhash.xxh3_128_digest(digests[16 * a : 16 * b])
                        at.append(i)
                        got.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), numbers[a], numbers[b - 1] + 1))
                columns = list(zip(*got, strict=True)) or [()] * 4
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)), *arrays], ["row", "doc_id", "text_hash", "h1", "h2", "start", "end"])

    return map_arrow(lines.select("row", "doc_id", "text_hash", "numbers", "sizes", "digests", "places"), each, "row long, doc_id long, text_hash long, h1 long, h2 long, start int, end int")


def merged(spans: DataFrame) -> DataFrame:
    """(row, runs): the spans (row, start, end) of each row, those that touch made one."""
    before = Window.partitionBy("row").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = spans.withColumn("new", apart.cast("int")).withColumn("nth", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def repeated_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(row, runs): the merged runs of lines, as (start, end), that stand at an earlier place."""
    known = written(hashed(docs, run, gram), "line-hashes")
    minima = known.select("row", F.explode("minima").alias("m")).select("row", "m.at", "m.fingerprint")
    shared = written(minima.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "shared-fingerprints")
    places = minima.join(shared, "fingerprint").groupBy("row").agg(F.collect_list("at").alias("places"))  # a table of its own: so the join can split a hot one's places
    around = extended(known.join(places, "row"), run, gram)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "start")
    met = written(around.select("row", "h1", "h2", "end", place.alias("place")), "extended-runs")
    discard(known, shared)
    first = met.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = written(first, "first-places")  # likewise
    later = met.join(first, ["h1", "h2"]).where(F.col("place") > F.col("first"))
    return merged(later.select("row", F.col("place.start").alias("start"), "end"))


def without_runs(texts: DataFrame) -> DataFrame:
    """``texts`` with struct ``d`` and runs: d.text loses the lines of the runs; adds n_lines_cut."""

    lines, gone = F.split(F.col("d.text"), "\n", -1), F.col("runs")
    cut = F.aggregate(gone, F.lit(0), lambda a, r: a + r["end"] - r["start"])
    left = F.concat(F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["end"])).alias("a"), F.concat(F.transform(gone, lambda r: r["start"]), F.array(F.size("lines"))).alias("b")), lambda z: F.slice("lines", z["a"] + 1, z["b"] - z["a"])))
    out = texts.withColumn("lines", lines).withColumn("left", F.when(gone.isNotNull(), F.array_join(F.flatten(left), "\n")))
    return out.withColumn("d", F.col("d").withField("text", F.coalesce("left", "d.text"))).withColumn("n_lines_cut", F.coalesce(cut, F.lit(0)).cast("long")).drop("lines", "left")


def dedup_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """Texts without the runs of lines that stand earlier: struct ``d`` (the row), ``runs``, n_lines_cut.

    A line is what stands between newlines; lines are equal if their words are. Null and empty texts stay as
    they are. Rows that share id and text are one document and are cut alike, so repeated rows keep their own
    text. Documents with null ids come last in the order of places. A document whose lines all go is kept with
    an empty text. Empty tables give empty results; any other columns come through.
    """
    whole = written(wrapped(docs).withColumn("row", F.monotonically_increasing_id()), "numbered-docs")
    text = F.col("d.text").cast("string")
    keyed = whole.select("row", F.col("d.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = written(repeated_runs(keyed, run, gram), "runs")
    return without_runs(whole.join(found, "row", "left").select("d", "runs"))


def cut_repeats(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """``docs`` with the columns it has; n_chars follows the text where there is such a column."""
    done = dedup_lines(docs, run, gram)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("d", F.col("d").withField("n_chars", F.when(F.col("n_lines_cut") > 0, F.length("d.text").cast(kind)).otherwise(F.col("d.n_chars"))))
    return unwrapped(done, docs)


def op3_line_dedup(spark, sf_dir):
    """All documents with the text that is left, and which lines went."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("d.doc_id", "d.text", "n_lines_cut", F.coalesce(F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ","), F.lit("")).alias("lines_cut"))
