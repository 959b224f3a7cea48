import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n, words=None):
    words = words or [a + b for a in "the and of in at".split() for b in "ra lo mi tu ke so".split()]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Odd texts, copies, near copies, shared passages, ties and repeated rows; some null ids."""
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(30_000))
    passage = "\n".join(sentence(r, 20) for _ in range(3))
    base = [sentence(r, r.randrange(60, 200)) + "\n" + sentence(r, 30) for _ in range(40)]
    odd = [None, "", " \t\r\n\x0b\x0c ", "one", "Two words", "ÀÉ ÄÖ éà 数字 😀 a", "a\x00b a_b 1-2", "#*$%&|<>", "x " * 500, long, long, "\n\n" + passage + "\n\n", passage.upper()]
    near = [b.replace("ra", "RA", 1) for b in base[:5]] + [b + " end" for b in base[5:10]]
    shared = [sentence(r, 12) + "\n" + passage + "\n" + sentence(r, 12) for _ in range(6)]
    shouting = [sentence(r, 80).upper() + "!!" for _ in range(3)]
    lines = ["\n".join([sentence(r, 6)] * 20)]
    return odd + base + near + base[:8] + shared + shouting + lines


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, texts[20]), (None, None), out[15], out[15], (7, "same id, other text")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    langs = ("en", "de", None)
    df = spark.createDataFrame([(d, t, langs[i % 3], f"s{i % 2}", 5) for i, (d, t) in enumerate(rows)], DOCS).repartition(3)
    clash = ["row", "w", "d", "n_words", "fp", "key", "runs", "stratum", "found", "score", "held_out", "length", "rank", "component_id", "n_lines_cut"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, rows):
    known = [(d, i % 2, i % 2, "x") for i, (d, _) in enumerate(rows)] + [(3, None, None, "x"), (10**9, 1, 1, "x")]
    return spark.createDataFrame(known, "doc_id long, quality int, toxic int, n_words string")


@pytest.fixture(scope="session")
def benchmark(spark, texts):
    from pyspark.sql import functions as F

    some = [(0, texts[15][:200]), (1, texts[16]), (2, "Two words"), (3, "one"), (4, ""), (5, None), (6, texts[15][:200]), (6, texts[15][:200]), (None, texts[17]), (7, texts[9][:300]), (11, "a b a"), (12, "ra " * 3)]
    return spark.createDataFrame(some, "item_id long, text string").withColumn("win", F.lit(1))
