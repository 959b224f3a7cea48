"""The pipeline against its stages' brute-force versions, and the queries against their SQL."""

import os
import random
from math import comb

import brute
import duckdb
import pytest

import corpus_pipeline
from pointloom.llm import quality
from pointloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, docs, labels, benchmark, rows, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"out{i}")
        stage(spark, table, str(tmp_path)).write.parquet(out)
        steps[name] = table = spark.read.parquet(out)
        assert name == "packing" or table.columns == docs.columns
    pairs = {k: [(r.doc_id, r.text) for r in v.select("doc_id", "text").collect()] for k, v in steps.items() if k != "packing"}
    good = [r for r in rows if not brute.quality_counts(r[1])[-1]]
    assert sorted(map(str, pairs["quality_rules"])) == sorted(map(str, good))  # too few labels for cutoffs of the method's own
    want = brute.cut_lines(good)
    assert sorted(map(str, pairs["line_dedup"])) == sorted(str((d, want[d, t])) for d, t in good)
    found = sorted((-1 if d is None else d, f"{brute.simhash(t):016x}") for d, t in pairs["near_dedup"])
    assert found == brute.one_of_each(pairs["line_dedup"], corpus_pipeline.NEAR)
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert sorted(map(str, pairs["decontamination"])) == sorted(str(r) for r in pairs["near_dedup"] if not brute.contamination([r], items)[0][-1])
    packed = steps["packing"].toPandas()
    assert packed.groupby("doc_id", dropna=False)["piece"].max().shape[0] == len({d for d, _ in pairs["decontamination"]})
    again = corpus_pipeline.run(spark, str(tmp_path))
    more = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece")  # both results are alive together
    one, two = (corpus_pipeline.packing(spark, steps["decontamination"], "") for _ in range(2))
    assert again.count() == more.count() == one.count() == two.count() == len(packed)


def test_stages_take_empty_tables(spark, none, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_quality_stage_with_enough_labels(spark, tmp_path):
    """Good documents hold few symbols; cutoffs are proven from 300 labels, and texts above them go."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(10**6)) + "#" * (r.random() < (0.02 if i % 10 else 0.5)) for _ in range(80))) for i in range(600)]
    spark.createDataFrame([(d, int(d % 10 > 0), 0) for d, _ in rows if d % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x.doc_id for x in corpus_pipeline.quality_rules(spark, df, str(tmp_path)).collect()}
    part = lambda t: -(-1000 * t.count("#") // len(t.split()))
    good = sorted(part(t) for d, t in rows if d % 2 and d % 10)
    above = next(k for k in range(len(good), -1, -1) if k <= len(good) * quality.SPARE and sum(comb(len(good), i) * quality.RISK**i * (1 - quality.RISK) ** (len(good) - i) for i in range(k + 1)) <= quality.DELTA / 20)
    cut = min(v for v in good if sum(x > v for x in good) <= above)
    assert left == {d for d, t in rows if part(t) <= cut} and 500 < len(left) < 560


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    order = lambda df: df[sorted(df.columns)].fillna("~").sort_values(sorted(df.columns)).reset_index(drop=True)
    a, b = order(QUERIES[name](spark, DATA).toPandas().astype(object)), order(con.sql(ORACLE_SQL[name]).df().astype(object))
    assert a.equals(b) or (a == b).all().all()
