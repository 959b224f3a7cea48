"""Every word behind three others meets the long contexts, whatever its context's hash and wherever a text is cut into slices."""

import numpy as np
import pytest

from pointloom.llm import langmodel


def tree():
    pairs = np.ones((256, 256), "i8")
    levels = langmodel.Levels(np.arange(256, dtype="i4"))
    return langmodel.prune(levels, [pairs.sum(0, keepdims=True)])


@pytest.mark.parametrize("size", [9, 16, 64, 1 << 20])
def test_all_places_are_found(monkeypatch, size):
    r = np.random.default_rng(2)
    bodies = [b" ".join(bytes(r.integers(97, 100, r.integers(1, 12)).tolist()) for _ in range(n)) + b"\n" for n in (1, 3, 4, 90, 2, 40)]
    words = [[x + b" " for x in b[:-1].split(b" ")[:-1]] + [b[:-1].split(b" ")[-1] + b"\n"] for b in bodies]

    def hashed(x):
        return int(langmodel.Hashes(np.frombuffer(x, "u1")).of(np.array([0]), np.array([len(x)])).view("i8")[0])

    want = [(i, hashed(b"".join(w[k - 3 : k])), hashed(w[k]) >> 32) for i, w in enumerate(words) for k in range(3, len(w))]
    whole = langmodel.score_bodies(tree(), bodies)[1]
    monkeypatch.setattr(langmodel, "slices", lambda b, d, f=langmodel.slices: f(b, d, size))
    got = langmodel.score_bodies(tree(), bodies)[1]
    assert list(zip(got.number.tolist(), got.context.tolist(), (got.word >> 32).tolist(), strict=True)) == want
    assert np.array_equal(got.word, whole.word)
