"""Quality rules with risk-controlled thresholds: DataFrame functions only.

Each rule rejects a document whose rate (say, symbols per word) exceeds a cutoff. Cutoffs are learnt from the labelled
documents: candidates are the rates of a stratum's good documents themselves, rounded up to a thousandth. Of ``n``
good documents, ``k`` lie above a candidate. If P(Bin(n, ``risk``) <= k) is within the level, the candidate's true rate
of false rejection is proven to be at most ``risk``: it is the exact binomial bound of an order statistic, so it holds
however many candidates of a rule are looked at. Rules and strata share ``delta`` by Bonferroni. Of the proven candidates
the strictest is taken that rejects at most ``SPARE`` of the good documents at hand, so that with many labels, which
prove much, few clean documents go.

With the parameters here a level is 0.05 / 20 = 0.0025, and a cutoff needs 197 good labels in a stratum: log(0.0025) / log(0.97). A
stratum with fewer proves no cutoff, and the rules reject nothing there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import table, unwrapped, words_of, wrapped, written

#: Each rule's rate is that of these two counts; rates are compared in thousandths, rounded up.
RULES = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_word_rate": ("n_repeat_words", "n_words"),
    "capital_rate": ("n_capitals", "word_chars"),
}
#: The share of good documents that a rule may reject in a stratum, how sure that is for all rules and strata together, and
#: the share that a cutoff may reject of the labelled ones.
RISK, DELTA, SPARE = 0.03, 0.05, 0.005
#: Thousandths of the largest cutoff that a rule can have: so the table of candidates is bounded.
TOP = 10_000
#: Languages with cutoffs of their own; all others, and null, share the stratum ``other``.
STRATA = ("de", "en", "es", "fr")
MIN_WORDS, MAX_REPEAT = 50, 50


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``d`` column; adds the counts. One row in, one row out: no shuffle.

    Three-word windows are found twice if their 64-bit hashes are. Sorting (hash, place) pairs puts
    equal windows side by side; the places found, sorted again, cover 3 words or up to the next place.
    """
    text = F.coalesce(F.col("d.text"), F.lit(""))
    out = docs.withColumn("w", words_of(text)).withColumn("n_words", F.size("w").cast("long"))
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p"))
    out = out.withColumn("windows", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), window))))
    same = lambda x, i: (F.get("windows", i - 1)["h"] == x["h"]) | (F.get("windows", i + 1)["h"] == x["h"])
    twice = F.filter("windows", lambda x, i: F.coalesce(same(x, i), F.lit(False)))
    out = out.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    out = out.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.regexp_extract_all(text, F.lit("[A-Z]"), F.lit(0))).cast("long").alias("n_capitals"),
    )


def rates() -> dict[str, Column]:
    """Each rule's rate in thousandths, rounded up, in whole numbers."""
    part = lambda a, b: F.coalesce(F.expr(f"(1000 * {a} + {b} - 1) div nullif({b}, 0)"), F.lit(0)).cast("long")
    return {rule: part(*counts) for rule, counts in RULES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words"))


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def log_factorial(x: Column) -> Column:
    """Stirling's series, at x + 10 and brought down by the ten factors between: to about 1e-12."""
    z = x + F.lit(11.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - F.log((x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0)) - F.log((x + 6.0) * (x + 7.0) * (x + 8.0) * (x + 9.0) * (x + 10.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed down from k; 1 where k is at or above the mean.

    Below the mean terms fall at least as fast as a normal curve's, so those beyond 12 standard deviations and 60 more, under
    1e-15 of the sum, are left out: the work grows with the root of n.
    """
    odds = (1 - p) / p
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        at = k - j
        term = a["term"] * (at + 1) / (n - at) * F.lit(odds)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    some = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long")), start, step)["sum"]).otherwise(1.0)
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(top) * some)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, spare: float = SPARE) -> DataFrame:
    """(stratum, a cutoff in thousandths for each rule; null where nothing is proven): at most 5 rows.

    ``measured`` has the counts with doc_id and stratum. A document is good if any of its labels says so;
    null labels and null ids are left out. Documents that the base rules reject don't count. Labelled rows are
    counted by (stratum, rule, rate): at most 5 x 4 x ``TOP`` rows, however many labels there are.
    """
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.least(rate, F.lit(TOP)).alias("cut")) for rule, rate in rates().items()])).alias("t")
    counted = held.select("stratum", each).groupBy("stratum", "t.rule", "t.cut").agg(F.count("*").alias("n_at"))
    over = Window.partitionBy("stratum", "rule").orderBy(F.desc("cut"))
    above = F.coalesce(F.sum("n_at").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    candidates = counted.select("stratum", "rule", "cut", above.alias("k"), F.sum("n_at").over(Window.partitionBy("stratum", "rule")).alias("n"))
    near = candidates.where((F.col("k") <= F.col("n") * F.lit(spare)) & (F.col("k") < F.col("n") * F.lit(risk)))
    level = delta / (len(RULES) * (len(STRATA) + 1))
    proven = near.where(binomial_tail(F.col("k"), F.col("n"), risk) <= level)
    return proven.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"{rule}_cut") for rule in RULES])


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed and kept. ``cuts`` has a row for each stratum at most, so it is broadcast."""
    over = [F.coalesce(rate > F.col(f"{rule}_cut"), F.lit(False)) for rule, rate in rates().items()]
    rejected = over[0] | over[1] | over[2] | over[3]
    out = measured.join(F.broadcast(cuts), "stratum", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, rates' cutoffs and verdict of every row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words, so they fail the base rules. Repeated rows are judged alike.
    Null ids are judged but can't be labelled. An empty table gives an empty result; with empty labels
    only the base rules reject.
    """
    known = docs.select(F.struct(F.col("text").cast("string").alias("text")).alias("d"), F.col("doc_id").alias("doc_id"), stratum(F.col("lang")).alias("stratum"))
    counted = written(measures(known).drop("d"), "measures")
    return judged(counted, thresholds(counted, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) that the rules keep, with their own columns alone.

    Null and empty texts fail the base rules and go. Repeated rows are judged alike. Rows with null ids are judged
    but never learnt from; a null or unknown language is of the stratum ``other``. An empty table gives an empty result. Counts are taken once: they are written beside the documents, and the verdict is a filter on that table,
    so texts are never shuffled.
    """
    known = wrapped(docs).withColumns({"doc_id": F.col("d.doc_id"), "stratum": stratum(F.col("d.lang"))})
    counted = written(measures(known), "measured-docs")
    return unwrapped(judged(counted, thresholds(counted.drop("d"), labels)).where("kept"), docs)


def op9_quality_rules(spark, sf_dir):
    """Every document judged under cutoffs learnt from all labelled ones."""
    out = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
