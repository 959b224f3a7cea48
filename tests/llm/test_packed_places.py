"""Places of long contexts are shuffled once, packed; however they are cut into packs, the scores are the same."""

from collections import Counter

import brute
import numpy as np
import pytest

from pointloom.llm import langmodel


def test_a_pack_keeps_all_places_in_few_bytes():
    r = np.random.default_rng(4)
    n = 200_000
    context, follow = (r.integers(0, 1 << 63, n, dtype="u8") * np.uint64(2) + r.integers(0, 2, n, dtype="u8") for _ in range(2))
    context[:5000], context[5000:5003] = context[0], (0, 1, (1 << 64) - 1)
    word = follow & np.uint64(0xFFFFFFFF00000000) | np.minimum(r.exponential(60_000, n), 1 << 31).astype("u8")
    word[:3000] = word[0]
    who = np.sort(r.integers(0, 500, n)) * 2 + (1 << 33)
    pack = langmodel.Pack(6, langmodel.PLACES)
    pack.add(who, context, word)
    rows = list(pack.rows())
    assert not pack.size and len(rows) == 64
    assert sum(len(x[-1]) for x in rows) < 15 * n  # a row of three numbers, in Spark and in Parquet, took about twice as much
    got = [langmodel.Pack.unpacked(*x[2:]) for x in rows]
    assert all((c >> np.uint64(58) == x[0]).all() for x, (_, c, _, _) in zip(rows, got, strict=True))
    found = sorted(x for w, c, f, t in got for x in np.repeat(np.stack([w.astype("u8"), c, f], 1), t, 0).tolist())
    assert found == sorted(np.stack([who.astype("u8"), context, word], 1).tolist())


@pytest.mark.parametrize(("wait", "bits", "tasks"), [(7, 1, 1), (1 << 20, 9, 5)])
def test_packs_of_any_size_score_alike(spark, monkeypatch, wait, bits, tasks):
    monkeypatch.setattr(langmodel, "LEAST_BITS", bits)
    r = np.random.default_rng(6)
    words = ["ab", "ba", "abc", "c", "cab"]
    runs = [" ".join(r.choice(words, 9)) for _ in range(4)]
    rows = [(i, " ".join([*r.choice(words, r.integers(0, 5)), *r.choice(runs, r.integers(0, 3))])) for i in range(50)]
    want = sorted((d, h, s) for d, h, s in brute.tree_scores(rows, langmodel))
    met = langmodel.met
    monkeypatch.setattr(langmodel, "met", lambda packed, _: met(packed, tasks))
    known = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(langmodel, "WAIT", wait)
    found = sorted((x.doc_id, x.held_out, x.score) for x in langmodel.score_texts(known).select("doc_id", "held_out", "score").collect())
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want], atol=2e-3)


def places(n: int, common: int):
    """Zipfian next words behind contexts of which one in eight occurs again."""
    r = np.random.default_rng(8)
    follow = r.integers(1, 1 << 32, 50_000, dtype="u8")
    next_word = np.minimum(r.zipf(1.3, n) - 1, len(follow) - 1)
    context = r.integers(0, 1 << 63, n, dtype="u8") * np.uint64(2)
    again = r.integers(0, n, n // 8)
    context[again], next_word[again] = context[0:-1:8][: len(again)], next_word[0:-1:8][: len(again)]
    log = (next_word.astype("u8") * np.uint64(7919) + np.uint64(20_000)) % np.uint64(200_000)
    return np.sort(r.integers(0, n // 500, n)) * 2 + (1 << 33), context, follow[next_word] << np.uint64(32) | log, follow[:common].astype("u4")


@pytest.mark.parametrize(("bits", "most"), [(5, 10.0), (9, 11.5)])
def test_repeated_contexts_and_frequent_words_cost_less_in_groups_of_any_size(bits, most):
    who, context, word, common = places(200_000, 4095)
    pack = langmodel.Pack(bits, langmodel.PLACES, common)
    pack.add(who, context, word)
    rows = list(pack.rows())
    assert sum(len(x[-1]) for x in rows) < most * len(who)  # 11.4 and 13.7 when each place had its context and hash
    got = [np.concatenate(x) for x in zip(*(langmodel.Pack.unpacked(*x[2:], common) for x in rows), strict=True)]
    found = sorted(x for w, c, f, t in [got] for x in np.repeat(np.stack([w.astype("u8"), c, f], 1), t, 0).tolist())
    assert found == sorted(np.stack([who.astype("u8"), context, word], 1).tolist())


def test_words_of_several_rows_cost_less():
    r = np.random.default_rng(9)
    who, keys = np.sort(r.integers(0, 400, 100_000)) * 2, r.integers(0, 1 << 62, 30_000, dtype="u8")[r.integers(0, 30_000, 100_000)]
    pack = langmodel.Pack(5, langmodel.RARE)
    pack.add(who, keys, np.ones(len(who), "i8"))
    rows = list(pack.rows())
    assert sum(len(x[-1]) for x in rows) < 3.6 * len(who)  # 4.2 when each row had its key


def test_the_named_words_are_those_that_places_have():
    body = b"x a bb ccc a bb a a bb y"
    common, n = langmodel.most_common(Counter(body.split()) + Counter({langmodel.END: 9}))
    assert n == [4, 3, 1, 1, 1]
    data, told, starts, numbers = next(langmodel.slices([body + langmodel.END], langmodel.DEPTH))
    places, _ = langmodel.places_of(data, told, starts, numbers, np.zeros(len(data)))
    hashes = (places.word.view("u8") >> np.uint64(32)).view("i8")  # of: ccc a bb a a bb y
    a, bb = common[:2]
    assert hashes.tolist()[1:6] == [a, bb, a, a, bb]
    assert langmodel.most_common(Counter({langmodel.END: 1}))[1] == []


def test_a_part_is_read_as_it_was_written():
    r = np.random.default_rng(10)
    number = r.integers(0, 3, 900).astype("u2")
    columns = [number, r.integers(0, 1 << 32, int((number == 0).sum())).astype("u4"), np.zeros(900, "u8"), r.integers(0, 2, 900).astype("u8") << np.uint64(40)]
    rows = np.array([0, 1, 70, 70, 900])
    edges = [rows, np.concatenate([[0], np.cumsum(number == 0)])[rows], rows, rows]
    for k, part in enumerate(langmodel.squeezed(columns, edges)):
        n = int(rows[k + 1] - rows[k])
        got = langmodel.spread(part, [n, lambda x: int((x[0] == 0).sum()), n, n], (2, 4, 8, 8))
        assert all((x == c[e[k] : e[k + 1]]).all() for x, c, e in zip(got, columns, edges, strict=True))


@pytest.mark.parametrize(("tasks", "parts", "share", "most"), [(41, 32, 1.0, 3.5), (1700, 1900, 0.02, 6.5)])
def test_sums_cost_few_bytes_in_tasks_of_any_number(tasks, parts, share, most):
    r = np.random.default_rng(11)
    row = np.concatenate([(p << 33) + np.flatnonzero(r.random(8000) < share) for p in range(parts)])
    n_tail = r.poisson(2, len(row)).astype("f8")
    tail = np.array([np.log10(np.minimum(r.zipf(1.4, int(n)), 68_000) + 1.0).sum() for n in n_tail])
    tail[:9], n_tail[:9] = (9.33, 9.34, 10, 40.5, 2**21, np.log10(2), 0, 1e-9, 300.25), 9
    gain = np.where(r.random(len(row)) < 0.1, r.normal(1, 2, len(row)), 0)
    packed = list(langmodel.Sums.packed(tasks, row, gain, n_tail, tail))
    assert sum(len(x[-1]) for x in packed) < most * len(row)  # 5.2 and 13.4 when each row had its whole number and all sums
    got = [np.concatenate(x) for x in zip(*(langmodel.Sums.unpacked(*x) for x in packed), strict=True)]
    order = np.argsort(got[0])
    want = row, np.rint(gain * 2.0**32), n_tail, np.rint(tail * 2.0**32)
    assert all((x[order] == y).all() for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("named", [0, 1, 2])
def test_a_pack_of_named_words_alone_or_of_none(named):
    word = np.array([7, 9, 7], "u8") << np.uint64(32) | np.uint64(5)
    common = np.array([7, 9], "u4")[:named]
    pack = langmodel.Pack(1, langmodel.PLACES, common)
    pack.add(np.array([4, 4, 6]), np.array([1, 2, 3], "u8"), word)
    who, context, got, times = langmodel.Pack.unpacked(*next(pack.rows())[2:], common)
    assert (who.tolist(), context.tolist(), got.tolist(), times.tolist()) == ([4, 4, 6], [1, 2, 3], word.tolist(), [1, 1, 1])
    assert not list(pack.rows())


EXACT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


@pytest.mark.parametrize(("wait", "head"), [(100, 0.02), (400, 0.02), (1000, 0.02), (400, 2.0), (1 << 20, 2.0)])
def test_sums_of_several_groups_are_all_kept(spark, monkeypatch, wait, head):
    """However many sums a task has had when it hands some on; with no frequent words as well."""
    monkeypatch.setattr(langmodel, "LEAST_BITS", 5)
    monkeypatch.setattr(langmodel, "HEAD", head)
    monkeypatch.setattr(langmodel, "WAIT", wait)
    met = langmodel.met
    monkeypatch.setattr(langmodel, "met", lambda packed, _: met(packed, 2))
    r = np.random.default_rng(13)
    rows = [(i, " ".join(f"w{k}" for k in np.minimum(r.zipf(1.3, r.integers(0, 60)), 300))) for i in range(150)]
    out = langmodel.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select(*EXACT).collect()
    assert sorted((*x[:5], round(x.base_score, 6)) for x in out) == brute.base_scores(rows)


def test_base_scores_with_nothing_to_learn_from(spark):
    rows = [(i, f"a b{i}") for i in range(300) if brute.crc(i, 7) == 2]
    out = langmodel.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).select(*EXACT).collect()
    assert sorted((*x[:5], round(x.base_score, 6) + 0.0) for x in out) == brute.base_scores(rows)
