"""License scans by diagonal voting.

A template of ``n`` words has ``n - k + 1`` word k-grams. The k-grams of all documents are joined with the
templates' by hash, and by their words; a match at document word p and template word t votes for diagonal p - t.
All votes on one diagonal: the template stands there word for word. Each diagonal that holds its part of the votes
gathers those of its neighbours, at most ``band`` words to either side, so that words put in or left out don't
split a match. Neighbours are those of the diagonal itself, never of its neighbours in turn: repeated
words nearby can't carry a match away. The band is verified by how many different k-grams of the template it has;
verified spans that overlap are merged.

So a notice that stands word for word is always found, whatever surrounds it. Templates are parameters, so their table's
size is known and it is broadcast. K-grams of no template are dropped inside each row, before the explode and the
join: first by the pairs of words that templates have, and those that pass by the whole k-gram.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import table, written
from pointloom.llm.decontaminate import words

#: Words of a k-gram, for phrases that count word for word and for notices; the narrowest band; the share of k-grams that a match has.
K_EXACT, K, SLACK, COVER = 2, 3, 2, 0.6


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False

    @property
    def k(self) -> int:
        return K_EXACT if self.exact else K

    @property
    def band(self) -> int:
        """Words by which a match may drift from its diagonal."""
        return max(SLACK, len(self.text.split(" ")) // 8)


#: The contract's phrases: they count only word for word.
BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))
#: Sentences of public licenses and of their usual notices, as words.
NOTICES = (
    Template("agpl", "under the terms of the gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("boost", "distributed under the boost software license version 1 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("cc-by", "licensed under a creative commons attribution license"),
    Template("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-nd", "licensed under the creative commons attribution noderivatives 4 0 international license"),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("eclipse", "made available under the terms of the eclipse public license"),
    Template("gpl", "this work is licensed under the gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
)


def grams_of(templates: Sequence[Template]) -> list[tuple]:
    """(template's number, label, exact, how many k-grams it has, band, k, place, k-gram)."""
    out = []
    for i, t in enumerate(templates):
        w = t.text.split(" ")
        n = len(w) - t.k + 1
        out += [(i, t.label, t.exact, n, t.band, t.k, at, " ".join(w[at : at + t.k])) for at in range(n)]
    return out


def _found(grams: Sequence[tuple]) -> Column:
    """Places and k-grams of column ``w`` that some template has."""

    def known(x: Column, texts: set[str]) -> Column:
        return F.xxhash64(x).isin([_hash(s) for s in sorted(texts)])

    def gram(i: Column, k: int) -> Column:
        return F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])

    def of(k: int) -> Column:
        each = F.transform(places, lambda i: F.struct(i.alias("p"), gram(i, k).alias("gram")))
        return F.filter(each, lambda x: known(x["gram"], {g[-1] for g in grams if g[5] == k}))

    places = F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: known(gram(i, 2), {" ".join(g[-1].split(" ")[:2]) for g in grams}))
    return F.when(F.size("w") >= 2, F.concat(*[of(k) for k in sorted({g[5] for g in grams})]))


def _hash(text: str) -> int:
    """Spark's xxhash64 of a text."""
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: row, doc_id, n_words. spans: row, label, exact, first and last word, share of the template's k-grams.

    Null and empty texts have no words and no spans. Templates of fewer words than a k-gram are not found. Repeated
    rows are scanned apart; an empty table gives empty results; other columns aren't read.
    """
    spark, grams = docs.sparkSession, grams_of(templates)
    held = spark.createDataFrame(grams, "tid int, label string, exact boolean, n_grams int, band int, k int, at int, gram string")
    w = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text").cast("string")).alias("w"))
    known = written(w.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), _found(grams).alias("found")), "grams")
    each = known.select("row", F.explode("found").alias("f")).select("row", "f.p", "f.gram")
    votes = each.join(F.broadcast(held), "gram").withColumn("diagonal", F.col("p") - F.col("at"))
    line = votes.groupBy("row", "tid", "label", "exact", "n_grams", "k", "band", "diagonal").agg(F.count("*").alias("n"))
    exact = line.where(F.col("exact") & (F.col("n") == F.col("n_grams"))).select("row", "label", "exact", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_grams") + F.col("k") - 2).alias("last"), F.lit(1.0).alias("cover"))
    #: A band that has enough k-grams has a diagonal with its part of them.
    seeds = line.where(~F.col("exact") & (F.col("n") * (2 * F.col("band") + 1) >= F.col("n_grams") * cover)).select("row", "tid", F.col("diagonal").alias("seed"))
    near = votes.where(~F.col("exact")).select("row", "tid", "label", "n_grams", "k", "p", "at", F.explode(F.sequence(F.col("diagonal") - F.col("band"), F.col("diagonal") + F.col("band"))).alias("seed"))
    bands = near.join(seeds, ["row", "tid", "seed"]).groupBy("row", "tid", "label", "n_grams", "k", "seed")
    judged = bands.agg(F.size(F.collect_set("at")).alias("n"), F.min("p").alias("first"), (F.max("p") + F.first("k") - 1).alias("last")).where(F.col("n") >= F.col("n_grams") * cover)
    before = Window.partitionBy("row", "tid").orderBy("first", "seed")
    apart = F.coalesce(F.col("first") > F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = judged.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("row", "tid", "label", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.col("n") / F.col("n_grams")).alias("cover"))
    return known.select("row", "doc_id", "n_words"), exact.unionByName(merged.select("row", "label", F.lit(False).alias("exact"), "first", "last", "cover"))


def license_labels(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), by the contract: see ``scan`` for the odd cases."""
    rows, spans = scan(docs, templates)
    base = lambda x: F.when(F.col("exact"), x)
    joined = lambda x: F.array_join(F.sort_array(F.collect_set(x)), ",")
    by_row = spans.groupBy("row").agg(F.count(base(F.lit(1))).alias("n_base"), F.min(base(F.col("first"))).alias("first_word"), F.max(base(F.col("first"))).alias("last_word"), joined(base(F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("cover").alias("score"))
    out = rows.join(by_row, "row", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    full = {c: F.coalesce(c, v) for c, v in none.items()} | {c: F.col(c).cast("long") for c in ("first_word", "last_word")}
    return out.withColumns(full).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_license_scans(spark, sf_dir):
    """Every document against all templates."""
    return license_labels(table(spark, sf_dir, "documents"))
