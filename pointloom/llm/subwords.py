"""Hashed character n-grams of words, and a linear softmax over their averaged embeddings, in NumPy.

Words are runs of letters, digits and any non-ASCII characters, lower-cased, in UTF-8; blanks stand around
each. An n-gram lies within a word and the blanks at its ends, so prefixes and suffixes are told from inner
parts. All n-grams of many texts are hashed at once by array operations over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes hashed at once.
SLICE = 1 << 20


def normal(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TABLE) + b" "


def slices(texts: Sequence[str | None], limit: int = SLICE) -> Iterator[tuple[bytes, np.ndarray, list[int]]]:
    """(bytes, starts, numbers): texts put together up to ``limit`` bytes; a longer one is cut, at blanks, in several parts."""
    parts, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        rest = normal(text or "")
        while rest:
            cut = len(rest)
            if cut > limit:
                blank = rest.rfind(b" ", 1, limit)
                cut = blank + 1 if blank > 0 else limit  # a word longer than that is cut
            part, rest = rest[:cut], rest[cut:]
            rest = b" " + rest if rest else rest
            if parts and size + len(part) > limit:
                yield b"".join(parts), np.cumsum([0, *map(len, parts)])[:-1], numbers
                parts, numbers, size = [], [], 0
            parts.append(part)
            numbers.append(i)
            size += len(part)
    if parts:
        yield b"".join(parts), np.cumsum([0, *map(len, parts)])[:-1], numbers


def grams(data: bytes, sizes: Sequence[int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of all n-grams of each size. ``buckets`` is a power of two."""
    b = np.frombuffer(data, "u1").astype("u8")
    blank, shift = b == 32, np.uint64(64 - (buckets.bit_length() - 1))
    code = b + np.uint64(1)
    for n in range(2, max(sizes) + 1):
        if len(b) < n:
            return
        code = code[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :] + np.uint64(1)
        inner = ~blank[1 : len(b) - n + 2] if n > 2 else ~(blank[:-1] & blank[1:])
        ok = inner if n <= 3 else ok[:-1] & ~blank[n - 2 : len(b) - 1]
        if n in sizes:
            at = np.flatnonzero(ok)
            yield at, ((code[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype("i8")


def counts(texts: Sequence[str | None], sizes: Sequence[int], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text, buckets ascending."""
    found: list[list] = [[] for _ in texts]
    for data, starts, numbers in slices(texts):
        each = list(grams(data, sizes, buckets))
        if not each:
            continue
        at, bucket = (np.concatenate(x) for x in zip(*each, strict=True))
        key, n = np.unique((np.searchsorted(starts, at, "right") - 1) * buckets + bucket, return_counts=True)
        edges = np.searchsorted(key, np.arange(len(starts) + 1) * buckets)
        for j, i in enumerate(numbers):
            found[i].append((key[edges[j] : edges[j + 1]] - j * buckets, n[edges[j] : edges[j + 1]]))
    out = []
    for parts in found:
        if len(parts) == 1:
            out.append(parts[0])
        else:
            key, inverse = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, "i8")]), return_inverse=True)
            out.append((key, np.bincount(inverse, np.concatenate([p[1] for p in parts] or [np.zeros(0)]), len(key)).astype("i8")))
    return out


def scores(texts: Sequence[str | None], weights: np.ndarray, sizes: Sequence[int], pad: float = 0) -> np.ndarray:
    """Averages over each text's n-grams of the rows of ``weights`` (buckets x classes); zero without n-grams."""
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    columns = [np.ascontiguousarray(weights[:, c]) for c in range(weights.shape[1])]
    for data, starts, numbers in slices(texts):
        edges = np.append(starts, len(data))
        for at, bucket in grams(data, sizes, len(weights)):
            cuts = np.searchsorted(at, edges)
            np.add.at(n, numbers, np.diff(cuts))
            for c, column in enumerate(columns):
                sums = np.concatenate([[0.0], np.cumsum(column[bucket], dtype="f8")])
                np.add.at(total[:, c], numbers, np.diff(sums[cuts]))
    return total / np.maximum(n + pad, 1)[:, None]


class BagModel:
    """softmax(mean(embeddings of a text's n-grams) @ output + bias), both learnt jointly by Adam on minibatches."""

    def __init__(self, buckets: int, classes: int, dim: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.params = [rng.normal(0, 0.1, (buckets, dim)).astype("f4"), rng.normal(0, 0.1, (dim, classes)).astype("f4"), np.zeros(classes, "f4")]

    def fit(self, bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float, scale: float, batch: int = 128, decay: float = 0.0, pad: float = 0, seed: int = 2) -> BagModel:
        rng, moments, step = np.random.default_rng(seed), [(np.zeros_like(p), np.zeros_like(p)) for p in self.params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                sizes = [len(bags[i][0]) for i in chosen]
                index, doc = np.concatenate([bags[i][0] for i in chosen]), np.repeat(np.arange(len(chosen)), sizes)
                value = np.concatenate([bags[i][1] / max(1, bags[i][1].sum() + pad) for i in chosen]).astype("f4") * scale
                used, place = np.unique(index, return_inverse=True)
                emb, out, bias = self.params
                rows = emb[used]
                mean = np.stack([np.bincount(doc, value * rows[place, d], len(chosen)) for d in range(emb.shape[1])], 1).astype("f4")
                logits = mean @ out + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(chosen)), labels[chosen]] -= 1
                p *= (weights[labels[chosen]] / len(chosen))[:, None]
                back = p @ out.T
                grad = np.stack([np.bincount(place, value * back[doc, d], len(used)) for d in range(emb.shape[1])], 1).astype("f4") + decay * rows
                step += 1
                lr = rate * (1 - epoch / epochs)
                for j, (g, rows_of) in enumerate(((grad, used), (mean.T @ p, slice(None)), (p.sum(0), slice(None)))):
                    m, v = moments[j]
                    m[rows_of] = 0.9 * m[rows_of] + 0.1 * g
                    v[rows_of] = 0.999 * v[rows_of] + 0.001 * g * g
                    self.params[j][rows_of] -= lr * (m[rows_of] / (1 - 0.9**step)) / (np.sqrt(v[rows_of] / (1 - 0.999**step)) + 1e-8)
        self.scale = scale
        return self

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets x classes, classes): what each n-gram adds to the logits when averaged, and the bias."""
        emb, out, bias = self.params
        return (emb @ out * self.scale).astype("f4"), bias.astype("f8")


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
