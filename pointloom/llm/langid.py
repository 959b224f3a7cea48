"""Language identification by averaged hashed subword embeddings under a linear softmax.

The model is fitted on the driver, by stochastic gradient descent in NumPy, to a bounded sample: ``ROWS`` documents in all,
dealt evenly to the languages that occur, those with the smallest hashes of id and text, and ``MAX_ENTRIES`` n-gram
counts. Each gives its whole text and one short stretch of it, so that short texts are learnt too. A fifth of the
sample isn't learnt from: on it, the temperature of the softmax is fitted, and the least score that keeps the share of
errors among accepted texts within ``ERRORS``, by an exact binomial bound. Examples are fitted in the order of
(language, hash), so scores don't depend on partitions. Every document is then scored whole, where it lies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import crc_mod, map_arrow, table
from pointloom.llm.sampling import Bag, draw_of, sample
from pointloom.llm.subwords import BagModel, counts, scores, softmax

SIZES, BUCKETS, DIM = (2, 3, 4), 1 << 16, 8
#: Rows of one language and of all that the model may be fitted to, bag entries in all, and words of a short stretch.
PER_LANG, ROWS, MAX_ENTRIES, STRETCH = 1200, 48_000, 20_000_000, 8
EPOCHS, RATE, SCALE, DECAY = 6, 0.02, 20.0, 1e-5
ERRORS, CONFIDENCE = 0.01, 0.95
_LETTER = re.compile(r"[^\W\d_]").search


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float  # texts that score less are rejected


def rows_of(docs: DataFrame, allowed: Column) -> DataFrame:
    """(label, draw, text) of all rows that may be learnt from."""
    text = F.col("text").cast("string")
    known = docs.where(F.col("lang").isNotNull() & text.isNotNull() & F.col("doc_id").isNotNull() & allowed)
    return known.select(F.col("lang").cast("string").alias("label"), draw_of(F.col("doc_id"), text).alias("draw"), text.alias("text"))


def whole_and_short(texts: list[str], draws: list[int]) -> list[list[Bag]]:
    """The bags of each text and of a stretch of it, whose place the draw decides."""
    words = [t.split() for t in texts]
    begins = [d % max(1, len(w) - STRETCH) for d, w in zip(draws, words, strict=True)]
    short = [" ".join(w[b : b + STRETCH]) for w, b in zip(words, begins, strict=True)]
    found = counts(texts + short, SIZES, BUCKETS)
    return [[found[i], found[len(texts) + i]] for i in range(len(texts))]


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits, out of a grid, under which the labels are likeliest."""
    at = np.arange(len(labels))
    return min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(np.maximum(softmax(logits / t)[at, labels], 1e-12)).sum())


def least_score(score: np.ndarray, right: np.ndarray, errors: float = ERRORS, confidence: float = CONFIDENCE) -> float:
    """The smallest score above which errors are proven rarer than ``errors``; 0 if that holds for all."""

    def tail(k: int, n: int) -> float:
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(errors) + (n - i) * math.log1p(-errors)) for i in range(k + 1))

    for least in (0.0, *np.linspace(0.3, 0.99, 24)):  # from lenient to strict; the first proven one is taken
        kept = score >= least
        if kept.any() and tail(int((~right[kept]).sum()), int(kept.sum())) <= (1 - confidence) / 25:
            return float(least)
    return 0.99


def train(docs: DataFrame, allowed: Column) -> Model:
    found = sample(rows_of(docs, allowed), lambda n: dict.fromkeys(n, max(1, min(PER_LANG, ROWS // len(n)))), MAX_ENTRIES, whole_and_short)
    langs = sorted(set(found.labels))
    if not langs:
        return Model(["und"], np.zeros((BUCKETS, 1), "f4"), np.zeros(1), 1.0, 0.0)
    number = {x: i for i, x in enumerate(langs)}
    y = np.repeat([number[x] for x in found.labels], 2)
    bags = [b for both in found.bags for b in both]
    nth = np.concatenate([np.arange(n) for n in np.bincount(y[::2])])  # within the language, by draw
    aside = np.repeat(nth % 5 == 4, 2)  # a language of few rows is learnt from first
    learn = np.flatnonzero(~aside)
    each = np.bincount(y[learn], minlength=len(langs))
    model = BagModel(BUCKETS, len(langs), DIM).fit([bags[i] for i in learn], y[learn], len(learn) / np.maximum(each, 1) / len(langs), EPOCHS, RATE, SCALE, decay=DECAY)
    w, b = model.weights()
    held = np.flatnonzero(aside)
    if not len(held):
        return Model(langs, w, b, 1.0, 0.0)
    logits = np.stack([(w[bags[i][0]] * bags[i][1][:, None]).sum(0) / max(1, bags[i][1].sum()) for i in held]) + b
    t = temperature_of(logits, y[held])
    p = softmax(logits / t)
    return Model(langs, w, b, float(t), least_score(p.max(1), p.argmax(1) == y[held]))


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, accepted.

    Learns from the texts and languages of rows that aren't held out; by default those with crc32(doc_id) mod 5 = 0
    are. Null texts and texts without a letter are ``und`` with score 0. ``accepted`` is false where the score
    is below the calibrated least one. Rows with null languages or ids are never learnt from, but judged. Repeated
    rows are judged alike and learnt from once; rows that share an id alone are examples of their own. An empty table gives an empty result. Other columns are ignored.
    """
    held = crc_mod(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ~held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            p = softmax((scores(texts, model.weights, SIZES) + model.bias) / model.temperature)
            letters = np.array([bool(t) and _LETTER(t) is not None for t in texts], bool)
            score = np.where(letters, p.max(1), 0.0)
            names = [model.langs[k] if ok else "und" for k, ok in zip(p.argmax(1), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(letters & (score >= model.least))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    known = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(known, run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op10_language_id(spark, sf_dir):
    """Every document, learnt from the languages outside the held-out fifth."""
    return identify(table(spark, sf_dir, "documents"))
