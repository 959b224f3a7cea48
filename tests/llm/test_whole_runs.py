"""Line dedup against its rule itself: every run of lines, not only the windows, is looked for at earlier places."""

import random

from conftest import DOCS

from pointloom.llm import linededup


def whole_runs(texts, run):
    """Lines with words that lie in a run of ``run`` words or more that stands earlier. Texts in the order of places."""
    docs = [[tuple(x.split()) for x in t.split("\n") if x.split()] for t in texts]
    first, gone = {}, [set() for _ in docs]
    for write in (True, False):
        for k, lines in enumerate(docs):
            for i in range(len(lines)):
                for j in range(i + 1, len(lines) + 1):
                    if sum(map(len, lines[i:j])) >= run:
                        if write:
                            first.setdefault(tuple(lines[i:j]), (k, i))
                        elif first[tuple(lines[i:j])] < (k, i):
                            gone[k].update(range(i, j))
    return [[" ".join(x) for i, x in enumerate(lines) if i not in g] for lines, g in zip(docs, gone, strict=True)]


def left(spark, texts, **sizes):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    found = {r.doc_id: r.text for r in linededup.cut_repeats(df, **sizes).collect()}
    return [[" ".join(x.split()) for x in found[i].split("\n") if x.split()] for i in range(len(texts))]


def test_ends_of_repeated_runs_go(spark):
    r = random.Random(1)
    line = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    texts = []
    for sizes in ([60, 5, 20], [45, 10, 30], [49, 49], [20, 20, 20, 49]):
        copied = "\n".join(map(line, sizes))
        texts += [line(9) + "\n" + copied + "\n" + line(8), line(7) + "\n\n" + copied + "\n" + line(6)]
    want = whole_runs(texts, linededup.RUN)
    assert all(len(x) == 2 for x in want[1::2])
    assert left(spark, texts) == want


def test_whole_runs_at_random(spark):
    r = random.Random(2)
    lines = [" ".join(r.choice("abcdef") + str(k) for _ in range(k % 5 + 1)) for k in range(12)] + ["a", "b c", "", ""]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(14))) for _ in range(150)]
    assert left(spark, texts, run=6, gram=3) == whole_runs(texts, 6)
