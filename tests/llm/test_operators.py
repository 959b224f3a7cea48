"""The ten operators against brute-force versions, over odd, repeated and empty input."""

import re
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import decontaminate, langid, langmodel, licenses, linededup, packing, quality, sampling, simhash, subwords, toxicity, urlfilter

first = lambda row: tuple(-1 if v is None else v for v in row)


def got(df, *columns):
    return sorted(first(r) for r in df.select(*columns).collect())


# ---- 1


def test_packing(docs, rows):
    encode = packing.Encoder(packing.tokenizer_path())
    out = packing.pack(docs, capacity=64).toPandas()
    want = []
    for d, text in rows:
        ids = np.append(np.array(encode.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4"), 2)
        cut = len(ids) % 64 or 64
        ends = [0, *range(cut, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        want += [(-1 if d is None else d, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    out["doc_id"] = out["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out.itertuples())
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= np.ceil(out["length"].sum() / 64) * 1.02 + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 50), max_size=12))
def test_slots_hold_every_rank_once(counts):
    seen, used = {k: [] for k in counts}, {}
    for length, r0, r1, s0, per, offset in packing.plan_slots(counts, 40):
        seen[length] += range(r0, r1)
        for j in range(r1 - r0):
            used.setdefault(s0 + j // per, []).append((offset + j % per * length, length))
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aéÉß 's\n\t\u00a0\u2028٣数😀_1#<|endoftext|>", max_size=60))
def test_encoder_equals_the_library(text):
    encode = packing.encoder(packing.tokenizer_path())
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


# ---- 2


@pytest.mark.parametrize("size", [10, 4])
def test_contamination(docs, benchmark, rows, size):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    out = decontaminate.contamination(docs, benchmark, size)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(rows, items, size)
    kept = decontaminate.keep_clean(docs, benchmark, size)
    assert kept.columns == docs.columns
    bad = {(d, t) for d, t in rows if brute.contamination([(d, t)], items, size)[0][-1]}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(r) for r in rows if r not in bad)


def test_a_full_bitmap_drops_nothing(docs, benchmark, rows, monkeypatch):
    """With 64 bits for all shingles, nearly every place passes; the joins decide."""
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    monkeypatch.setattr(decontaminate, "BITMAP", 64)
    out = decontaminate.contamination(docs, benchmark)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(rows, items)


def test_clean_rows_of_odd_tables(none, docs, benchmark):
    assert decontaminate.keep_clean(none, benchmark).count() == 0
    odd = docs.where("text is null or text = ''")
    assert sorted(map(str, decontaminate.keep_clean(odd, benchmark).collect())) == sorted(map(str, odd.collect()))


# ---- 3


def test_line_dedup(docs, rows):
    want = brute.cut_lines(rows)
    out = linededup.cut_repeats(docs)
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    expected = [(d, t if t is None else want[d, t]) for d, t in rows]
    assert sorted(map(str, (f[:2] for f in found))) == sorted(map(str, expected))
    changed = {(d, want[d, t]) for d, t in rows if t is not None and want[d, t] != t}
    assert all(n == (len(t) if (d, t) in changed else 5) for d, t, n in found if t is not None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b c", "", "d e f", "g h i j"]), max_size=30), st.integers(2, 9))
def test_minima_are_those_of_each_window(lines, run):
    numbers, sizes, digests = linededup.lines_of("\n".join(lines))
    gram = run // 2
    ends, chosen, prints = linededup.minima_of(sizes, digests, run, gram)
    for i, (end, at) in enumerate(zip(ends, chosen, strict=True)):
        assert sum(sizes[i:end]) >= run > sum(sizes[i : end - 1])
        inside = [k for k in range(i, end) if sum(sizes[k:end]) >= gram]
        assert at == min(inside, key=lambda k: (prints[k], -k))
    assert len(ends) == len(sizes) or sum(sizes[len(ends) :]) < run
    assert [lines[i] for i in numbers] == [x for x in lines if x]


def test_minima_are_sparse():
    r = np.random.default_rng(4)
    sizes, digests = [5] * 4000, r.bytes(16 * 4000)
    _, chosen, _ = linededup.minima_of(sizes, digests)
    assert len(set(chosen)) < 0.4 * len(sizes)


def test_more_shared_with_a_second_place_than_with_the_first(spark):
    """The third text shares a minimum with both others, but its first lines only with the second."""
    r = np.random.default_rng(6)
    line = lambda: " ".join(f"w{r.integers(10**9)}" for _ in range(13))
    lines = [line() for _ in range(12)]
    texts = ["\n".join([line(), *lines[6:]]), "\n".join(lines), "\n".join([line(), *lines])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {x.doc_id: x.text for x in linededup.cut_repeats(df).collect()}
    assert left[2] == texts[2].split("\n")[0] and left == {d: t for (d, _), t in brute.cut_lines(list(enumerate(texts))).items()}


def test_many_runs_in_a_long_text(spark):
    """5,000 repeated lines, each between lines of its own."""
    r = np.random.default_rng(7)
    line = lambda n: " ".join(f"w{r.integers(10**9)}" for _ in range(n))
    repeated = line(50)
    text = "\n".join(x for _ in range(5000) for x in (repeated, line(3)))
    out = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.n_lines_cut == 4999 == len(out.runs) and out.d.text.count(repeated) == 1


# ---- 4


def test_simhash(docs, rows):
    out = simhash.near_duplicates(docs)
    assert got(out, "doc_id", "fingerprint", "component_id") == brute.simhash_components(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, f"{brute.simhash(r.text):016x}") for r in kept.collect()) == brute.one_of_each(rows)


def test_unrelated_texts_all_stay(spark, tmp_path):
    """Clashing and null ids: only copies go."""
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{r.integers(10**9)}" for _ in range(60)) for _ in range(5)]
    rows = list(zip((1, 1, 2, None, None), texts, strict=True))
    df = spark.createDataFrame([*rows, (1, texts[4]), (9, texts[0]), (None, texts[3])], "doc_id long, text string")
    left = {(x.doc_id, x.text) for x in simhash.keep_one(df).collect()}
    assert left == {(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (1, texts[4])}
    assert simhash.keep_one(df).count() == 5


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 6])
def test_links_and_components(spark, radius):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 200, dtype="u8")
    flips = [int(b) ^ sum(1 << int(i) for i in set(r.integers(0, 64, k % 7 + 1))) for k, b in enumerate(base)]
    chain = [(1 << k) - 1 for k in range(0, 60, 2)]
    prints = sorted({*map(int, base), *flips, *chain})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius)
    found = {tuple(sorted(p)) for p in pairs.collect()}
    assert found == {(a, b) for a, x in zip(signed, prints, strict=True) for b, y in zip(signed, prints, strict=True) if a < b and (x ^ y).bit_count() <= radius}
    roots = dict(simhash.components(pairs).collect())
    ends = [p - (1 << 64) if p >> 63 else p for p in chain]
    assert radius == 1 or len({roots[e] for e in ends}) == 1 and roots[ends[0]] <= min(ends)


# ---- 5


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EN.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/ES/", "http://a.net?/es/", "x://y://z/w", "http://foo.org/x.net/es/", "http://spam-farm.org/a", "http://xample.com", "http://com/é", "http://a.org/ads/1", "http://h.org/" + "p" * 5000, "http://a.org/f.exe"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(4, urls[4], "clash")]
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in out[:5]] == [("", "")] * 4 + [("en.example.com", "/en/x")] and len(out) == len(rows)
    by = {r.page_id: (r.rule, r.verdict) for r in out}
    assert by[4] == ("example.com/en/", "block") and by[5] == ("www.example.com/en/", "allow") and by[6] == ("net/es/", "block") and by[7] == ("net/fr/", "block")
    assert by[8] == by[9] == by[11] == (None, "allow") and by[13] == (None, "allow") and by[14] == ("com/", "allow")
    assert by[12] == by[15] == by[17] == (None, "block") and by[0] == (None, "allow")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab*?", max_size=6), min_size=1, max_size=40), st.lists(st.text("abc", max_size=9), min_size=1, max_size=5))
def test_automaton_equals_regular_expressions(globs, texts):
    automaton = urlfilter.Automaton([urlfilter._tokens(g) for g in globs])
    want = [[re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), t) is not None for g in globs] for t in texts]
    assert automaton.matches([np.array([ord(c) for c in t], "i8") for t in texts]).tolist() == want


# ---- 6


def test_licenses(spark, docs, rows):
    base = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    more = ["CC-BY 4", "cc by cc by", "All rights\nRESERVED. General  Public-License", "Permission is granted, free of charge, to any person obtaining a copy of this software and its associated documentation files", "released under the MIT license", "general public"]
    table = docs.select("doc_id", "text", "w", "score").unionByName(spark.createDataFrame([(900 + i, t, "", "") for i, t in enumerate(more)], "doc_id long, text string, w string, score string"))
    out = licenses.license_labels(table).collect()
    assert len(out) == len(rows) + len(more)
    texts = dict(enumerate(more, 900))
    for r in out:
        if r.doc_id in texts:
            w = brute.letter_words(texts[r.doc_id])
            at = [(i, v) for k, v in base.items() for i in range(len(w)) if tuple(w[i : i + len(k)]) == k]
            assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
            assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in out}
    assert labels[903] == "mit" and labels[904] == "mit" and labels[905] == ""


def bands(words, template, cover=licenses.COVER):
    """From the words alone: the best share of the template's k-grams within a band around any diagonal."""
    t, k = template.text.split(" "), template.k
    n, best = len(t) - k + 1, 0.0
    votes = [(p - at, at) for p in range(len(words) - k + 1) for at in range(n) if words[p : p + k] == t[at : at + k]]
    for seed in {d for d, _ in votes}:
        if sum(d == seed for d, _ in votes) * (2 * template.band + 1) >= n * cover:
            best = max(best, len({at for d, at in votes if abs(d - seed) <= template.band}) / n)
    return best if best >= cover else 0.0


def test_notices_by_their_words(spark):
    """Every notice is found word for word, whatever stands around it; altered ones as plain loops find them."""
    r = np.random.default_rng(10)
    texts = [" ".join(t.text.split(" ")[:2]) + " " for t in licenses.NOTICES]
    texts = [x * 30 + t.text + " " + x * 5 for x, t in zip(texts, licenses.NOTICES, strict=True)]
    texts += ["licensed under " * 4 + "licensed under the apache license version 2 0", "permission is " * 30 + licenses.NOTICES[20].text]
    whole = len(texts)
    for t in licenses.NOTICES * 3:
        w = t.text.split(" ")
        for _ in range(r.integers(1, 4)):
            at = r.integers(len(w))
            w[at : at + 1] = ([], [w[at], "odd"], ["other"])[r.integers(3)]
        texts.append(" ".join(["noise"] * int(r.integers(4)) + w))
    out = {x.doc_id: x for x in licenses.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, text in enumerate(texts):
        w = brute.letter_words(text)
        exact = {t.label for t in licenses.BASE if any(w[j : j + len(t.text.split(" "))] == t.text.split(" ") for j in range(len(w)))}
        near = {t.label: bands(w, t) for t in sorted(licenses.NOTICES, key=lambda t: bands(w, t))}
        assert out[i].labels == ",".join(sorted(exact | {k for k, v in near.items() if v})), text
        assert np.isclose(out[i].score, max([*near.values(), float(bool(exact))]))
    assert all(t.label in out[i].labels.split(",") and out[i].score == 1 for i, t in enumerate(licenses.NOTICES))
    assert "apache" in out[whole - 2].labels and "mit" in out[whole - 1].labels


# ---- 7


def test_language_model(docs, rows):
    out = langmodel.score_texts(docs)
    found = sorted((*first(r)[:5], round(r.base_score, 6)) for r in out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    assert found == brute.base_scores(rows)
    scores = [r.score for r in out.select("score").collect()]
    assert all(np.isfinite(s) and s < 0 for s in scores)


def test_suffix_tree_equals_plain_dictionaries(spark):
    """Both tiers, learnt and scored: tiny texts with repeated runs of words, copies and held-out rows."""
    r = np.random.default_rng(11)
    words = ["ab", "ba", "abc", "é", "c", "cab"]
    runs = [" ".join(r.choice(words, 6)) for _ in range(4)]
    texts = [" ".join([*r.choice(words, r.integers(0, 5)), *r.choice(runs, r.integers(0, 3))]) for _ in range(60)]
    rows = [*enumerate([*texts, *texts[:10], "", None]), (None, "AB ab"), (3, "zz ü ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((-1 if x.doc_id is None else x.doc_id, x.held_out, round(x.score, 3)) for x in langmodel.score_texts(df).collect())
    want = sorted((d, h, round(s, 3)) for d, h, s in brute.tree_scores(rows, langmodel))
    assert len(found) == len(want)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 for a, b in zip(found, want, strict=True))
    assert any(abs(s - t) > 0.5 for (_, _, s), (_, _, t) in zip(want, sorted((d, h, round(s, 3)) for d, h, s in brute.tree_scores(rows, langmodel, long=False)), strict=True))


def test_texts_that_occur_twice_score_apart(spark):
    """What the long contexts gather grows with the corpus: copies are likelier, word for word, than single texts."""
    r = np.random.default_rng(12)
    texts = [" ".join("".join(r.choice(list("abcdefg"), 4)) for _ in range(400)) for _ in range(40)]
    rows = [*enumerate(texts), *enumerate(texts[:10], 100)]
    out = langmodel.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    score = {x.doc_id: x.score / x.n_tokens for x in out.collect()}
    assert min(score[i] for i in range(10)) > max(score[i] for i in range(10, 40)) + 0.1


def tree_of(bodies, depth=4, p_min=0.001, monkeypatch=None):
    pairs = np.zeros(65536, "i8")
    for b in bodies:
        for x, y in zip(b"\n" + b, b, strict=False):
            pairs[x * 256 + y] += 1

    def counts(_, levels, last):
        sizes = [(int(t.max()) + 1) * levels.size for t in levels.tables[-last:]]
        starts = np.cumsum([0, *sizes])
        tally = langmodel.Tally(levels, starts)
        for data, told, _, _ in langmodel.slices(bodies, langmodel.DEPTH):
            tally.add(data, told)
        total = tally.settle()
        return [total[a:b].reshape(-1, levels.size) for a, b in zip(starts, starts[1:], strict=False)]

    monkeypatch.setattr(langmodel, "level_counts", counts)
    return langmodel.prune(*langmodel.grow(None, pairs.reshape(256, 256), depth, p_min))


def test_tree_is_a_distribution_and_learns(monkeypatch):
    bodies = [b"abc abd abc\n", b"abc abc abc abd\n"] * 50
    tree = tree_of(bodies, monkeypatch=monkeypatch)
    probs = 10 ** tree.log10.reshape(-1, tree.levels.size)
    met = tree.levels.symbols.max()
    assert np.allclose(probs[:, 1:].sum(1) + probs[:, 0] * (256 - met), 1, atol=1e-5)
    score = lambda bodies: langmodel.score_bodies(tree, bodies)[0]
    own, other = score([b"abc abc\n", b"cba dba\n"])
    assert own > other
    assert np.allclose(score([bodies[0] * 3])[0], score([bodies[0] * 3, b"x\n"])[0])
    whole = score([bodies[1] * 20])
    monkeypatch.setattr(langmodel, "SLICE", 64)
    monkeypatch.setattr(langmodel, "slices", lambda b, d, f=langmodel.slices: f(b, d, 64))
    assert np.allclose(score([bodies[1] * 20]), whole)


# ---- 8 and 10


def synthetic(spark, n=400):
    r = np.random.default_rng(5)
    word = lambda s: "".join(r.choice(list(s), r.integers(2, 7)))
    out = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        w = [word("abcdefgh" if lang == "en" else "klmnopqü") for _ in range(r.integers(3, 60))]
        bad = i % 5 == 0
        if bad:
            w[:: max(2, len(w) // 6)] = ["zyx" + word("vw") for _ in w[:: max(2, len(w) // 6)]]
        out.append((i, " ".join(w), lang, int(bad)))
    docs = spark.createDataFrame([x[:3] for x in out] + [(None, "abc", "en"), (n, None, "en"), (n + 1, "", None), (n + 2, "12 34 !", "de")], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(x[0], 1, x[3]) for x in out], "doc_id long, quality int, toxic int")


def test_toxicity_and_language(spark):
    docs, labels = synthetic(spark)
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (brute.crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.9
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    found = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.text and any(c.isalpha() for c in r.text)]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert {r.doc_id: (r.lang_pred, r.score) for r in found if r.lang_pred == "und"} == {400: ("und", 0.0), 401: ("und", 0.0), 402: ("und", 0.0)}


def test_odd_texts_are_scored(docs, labels, rows):
    for out in (toxicity.toxicity(docs, labels), langid.identify(docs)):
        found = out.collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)


def test_scores_equal_counts():
    texts = ["Straße 12 àé", "", None, "a", "word " * 5000, "x" * 3000]
    w = np.random.default_rng(2).normal(size=(1 << 12, 2)).astype("f4")
    bags = subwords.counts(texts, (2, 3, 4), 1 << 12)
    want = [(w[b] * n[:, None]).sum(0) / max(1, n.sum()) for b, n in bags]
    assert np.allclose(subwords.scores(texts, w, (2, 3, 4)), want, atol=1e-4)
    few = list(subwords.slices(texts, 500))
    assert len(few) > 10 and b"".join(d for d, _, _ in few).count(b"word") == 5000


def test_sample_is_bounded_by_rows_and_entries(spark):
    df = spark.range(5000).selectExpr("if(id % 50 = 0, 'b', 'a') AS label", "id % 4000 AS draw", "concat('t', id) AS text")
    bag = lambda texts, _: [[(np.arange(10), np.ones(10))] for _ in texts]
    take = lambda most: sampling.sample(df.withColumn("draw", F.xxhash64("draw") % 1000 + 1000), lambda _: {"a": 300, "b": 300}, most, bag)
    got = take(10**6)
    assert {k: got.labels.count(k) for k in "ab"} == {"a": 300, "b": len({r[0] for r in df.where("label = 'b'").selectExpr("xxhash64(draw) % 1000").collect()})}
    assert list(zip(got.labels, got.draws, strict=True)) == sorted(set(zip(got.labels, got.draws, strict=True)))
    few = take(1000)
    assert few.labels.count("a") == 50 and list(few.draws[:50]) == list(got.draws[:50])


def test_bags_equal_plain_counts():
    def plain(text, sizes, buckets):
        data, out = subwords.normal(text), {}
        for n in sizes:
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if b" " in gram[1:-1] or (n == 2 and gram == b"  "):
                    continue
                code = 0
                for c in gram:
                    code = (code * 0x100000001B3 + c + 1) % 2**64
                bucket = ((code ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - (buckets.bit_length() - 1))
                out[bucket] = out.get(bucket, 0) + 1
        return out

    for text in ("Straße 12 àé", "a", "", "x  yz, the-end", "word " * 30):
        for sizes in ((2, 3, 4), (3, 4, 5)):
            (b, n), = subwords.counts([text], sizes, 1 << 12)
            assert dict(zip(b.tolist(), n.tolist(), strict=True)) == plain(text, sizes, 1 << 12)


def test_fit_equals_dense_steps():
    r = np.random.default_rng(3)
    bags = [(np.sort(r.choice(64, r.integers(1, 9), replace=False)), None) for _ in range(30)]
    bags = [(b, r.integers(1, 4, len(b))) for b, _ in bags]
    y, weights = r.integers(0, 3, 30), np.array([1.0, 0.5, 2.0])
    w, b = subwords.BagModel(64, 3, 4).fit(bags, y, weights, 3, 0.02, 20.0, batch=8, decay=1e-3, pad=2).weights()
    want_w, want_b = brute.fit_bags(bags, y, weights, 64, 3, 4, 3, 0.02, 20.0, 8, 1e-3, 2)
    assert np.allclose(w, want_w, rtol=1e-2, atol=1e-2) and np.allclose(b, want_b, atol=1e-3)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = synthetic(spark)
    for score in (lambda d: toxicity.toxicity(d, labels), langid.identify):
        one, seven = (sorted(map(str, score(docs.repartition(n)).collect())) for n in (1, 7))
        assert one == seven


def test_repeated_ids_and_rows_are_sampled(spark):
    """3,000 texts of one id, and 3,000 times the same row."""
    same = spark.range(3000).selectExpr("1L AS doc_id", "concat('text number ', id) AS text", "'en' AS lang").repartition(3)
    more = spark.range(3000).selectExpr("2L AS doc_id", "'ein text' AS text", "'de' AS lang").repartition(3)
    rows = langid.rows_of(same.unionByName(more), F.lit(True))
    got = sampling.sample(rows, lambda n: dict.fromkeys(n, langid.PER_LANG), langid.MAX_ENTRIES, langid.whole_and_short)
    assert got.labels.count("en") == langid.PER_LANG and got.labels.count("de") == 1
    found = langid.identify(same.unionByName(more), F.col("doc_id") < 0).select("doc_id", "lang_pred").distinct().collect()
    assert {r.doc_id: r.lang_pred for r in found} == {1: "en", 2: "de"}
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(same.unionByName(more), labels, F.col("doc_id") < 0)
    assert out.count() == 6000 and {r.predicted for r in out.where("doc_id = 1").collect()} == {1}


def test_every_language_is_learnt(spark):
    rows = [(i, "ein text ein wort", f"l{i % 60:02d}") for i in range(600)] + [(600, "seldom", "rare")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == sorted({x for _, _, x in rows}) and model.weights.shape[1] == 61


# ---- 9


def test_quality(spark, docs, labels, rows):
    out = quality.assess(docs, labels)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert found == sorted((-1 if d is None else d, *brute.quality_counts(t)) for d, t in rows)
    assert not out.where("base_failed and kept").count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


def cutoffs(good, n_strata=5, n_rules=4):
    """By plain loops: the strictest proven thousandth of each stratum and rule. ``good``: (stratum, rates) of good documents."""
    from fractions import Fraction
    from math import comb

    risk, level, out = Fraction(quality.RISK).limit_denominator(1000), quality.DELTA / n_strata / n_rules, {}
    for s in {s for s, _ in good}:
        for j in range(n_rules):
            values = [min(r[j], quality.TOP) for x, r in good if x == s]
            n = len(values)
            for cut in sorted(set(values)):
                k = sum(v > cut for v in values)
                if k <= n * quality.SPARE and sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) <= level:
                    out[s, j] = cut
                    break
    return out


def test_cutoffs_equal_plain_loops(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        s = ("en", "en", "en", "de", "fr", "other")[i % 6]
        if s == "fr" and i % 24 == 4:
            s = "es"
        rows.append((i, s, 100, 500, *(int(x) for x in r.geometric([0.2, 0.5, 0.05]) - 1), 10, int(r.geometric(0.1))))
    df = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long")
    labels = df.selectExpr("doc_id", "cast(doc_id % 5 <> 0 AS int) AS quality").unionByName(df.selectExpr("doc_id", "0 AS quality"))
    part = lambda a, b: -(-1000 * a // b)
    good = [(x[1], (part(x[4], 100), part(x[5], 10), part(x[6], 100), part(x[8], 500))) for x in rows if x[0] % 5 and 100 * x[6] <= 50 * x[2]]
    want = cutoffs(good)
    found = {(c.stratum, j): c[f"{rule}_cut"] for c in quality.thresholds(df, labels).collect() for j, rule in enumerate(quality.RULES) if c[f"{rule}_cut"] is not None}
    assert found == want and {s for s, _ in found} == {"en", "de", "fr", "other"}  # 100 labels of es prove nothing
    out = quality.judged(df, quality.thresholds(df, labels))
    kept = {x.doc_id for x in out.where("kept").collect()}
    over = lambda x: any((x[1], j) in want and v > want[x[1], j] for j, v in enumerate((part(x[4], 100), part(x[5], 10), part(x[6], 100), part(x[8], 500))))
    assert kept == {x[0] for x in rows if 100 * x[6] <= 50 * x[2] and not over(x)} and len(kept) < 3000
    few = quality.thresholds(df.limit(100), labels)
    assert not few.collect()


@pytest.mark.parametrize(("k", "n"), [(0, 50), (3, 400), (0, 1), (40, 9000), (7, 7), (2900, 100_000), (1, 197)])
def test_binomial_tail(spark, k, n):
    from fractions import Fraction
    from math import comb, exp, lgamma, log, log1p

    p = quality.RISK
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    want = 1.0 if k >= n * p else float(sum(Fraction(comb(n, i)) * Fraction(3, 100) ** i * Fraction(97, 100) ** (n - i) for i in range(k + 1))) if n < 10_000 else sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))
    assert np.isclose(got, want, rtol=1e-8)


# ---- all


def test_empty_tables(spark, none, docs, labels, benchmark):
    pages = spark.createDataFrame([], "page_id long, url string")
    for out in (packing.pack(none), decontaminate.contamination(none, benchmark), linededup.cut_repeats(none), simhash.near_duplicates(none), simhash.keep_one(none), urlfilter.filter_urls(pages), licenses.license_labels(none), langmodel.score_texts(none), toxicity.toxicity(none, labels), quality.assess(none, labels), quality.keep_good(none, labels), langid.identify(none)):
        assert out.count() == 0
    free = decontaminate.contamination(docs, benchmark.limit(0))
    assert free.where("contaminated").count() == 0 and decontaminate.keep_clean(docs, benchmark.limit(0)).count() == docs.count()
    plain = quality.assess(docs, labels.limit(0))
    assert plain.where("kept = base_failed").count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
