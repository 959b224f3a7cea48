"""Toxicity by averaged subword embeddings under a linear softmax.

The model is fitted on the driver to a bounded sample of the labelled rows: ``PER_CLASS`` rows of each
label at most, those with the smallest hashes of id and text, and ``MAX_ENTRIES`` n-gram counts in all, dealt to the
labels in that proportion. The n-grams are counted on the executors and fitted in the order of the hashes, so
scores don't depend on partitions. Every document is then scored whole, where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import crc_mod, map_arrow, table
from pointloom.llm.sampling import below, draw_of, sample, share_for
from pointloom.llm.subwords import BagModel, counts, scores, softmax

SIZES, BUCKETS, DIM = (3, 4, 5), 1 << 18, 4
#: Rows of label 0 and of label 1 that the model may be fitted to, and bag entries in all.
PER_CLASS, MAX_ENTRIES = (4500, 1500), 20_000_000
EPOCHS, RATE, SCALE, DECAY, WEIGHTS = 8, 0.02, 100.0, 1e-4, (1.0, 0.6)
#: Zero vectors averaged into every text: what few n-grams say of a short text is taken with caution.
PAD, CUTOFF = 300, 0.3


def ids_of(labels: DataFrame, allowed: Column) -> DataFrame:
    """(doc_id, label) of the labelled ids with the smallest hashes, ``PER_CLASS`` of each label at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).withColumn("draw", draw_of(F.col("doc_id")))
    n = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    got = each.where(below({k: share_for(PER_CLASS[k], v) for k, v in n.items()})).toArrow().to_pylist() if n else []
    got.sort(key=lambda r: (r["draw"], r["doc_id"]))
    chosen = [(r["doc_id"], r["label"]) for k in n for r in [r for r in got if r["label"] == k][: PER_CLASS[k]]]
    return labels.sparkSession.createDataFrame(chosen, "doc_id long, label int")


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the n-grams and a bias, one column each; without labelled rows of both kinds, zeros."""
    chosen = F.broadcast(ids_of(labels, allowed))  # at most sum(PER_CLASS) ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.join(chosen, "doc_id").withColumn("draw", draw_of(F.col("doc_id"), F.col("text")))
    found = sample(rows, lambda _: dict(enumerate(PER_CLASS)), MAX_ENTRIES, lambda texts, _: [[b] for b in counts(texts, SIZES, BUCKETS)])
    y = np.array(found.labels, "i8")
    if len(set(found.labels)) < 2:
        return np.zeros((BUCKETS, 1), "f4"), np.zeros(1)
    model = BagModel(BUCKETS, 2, DIM).fit([b for b, in found.bags], y, np.array(WEIGHTS), EPOCHS, RATE, SCALE, decay=DECAY, pad=PAD)
    w, b = model.weights()
    return w[:, 1:] - w[:, :1], b[1:] - b[:1]


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with score instead of text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            logit = scores([t.as_py() for t in batch.column(2)], w, SIZES, PAD) + b
            p = softmax(np.concatenate([np.zeros_like(logit), logit], 1))[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["doc_id", "held_out", "score"])

    return map_arrow(docs, run, "doc_id long, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Labels of held-out ids are never used; by default those with crc32(doc_id) mod 4 = 2. Null and empty texts
    score by the bias alone. A null id is judged like any other and never learnt from. Repeated rows are scored
    alike and learnt from once; an id with several labels counts as toxic if one says so, and each of its texts is an example. Without labels of both kinds every score is 0.5. Empty tables give empty results. Only doc_id and text
    are read; texts are read whole, a megabyte at a time.
    """
    held = crc_mod(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    model = train(docs, labels, ~held)
    out = score_texts(docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string").alias("text")), model)
    return out.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))


def op8_toxicity(spark, sf_dir):
    """Every document, learnt from the labels outside the held-out quarter."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
