"""Plain Python versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def blank_words(text):
    return BLANK.findall(text or "")


def letter_words(text):
    return LETTERS.findall((text or "").translate(AZ))


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def simhash(text):
    w = BLANK.findall((text or "").translate(AZ))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_roots(rows, radius=2):
    """The prints of the rows, and for each row the number of its component."""
    prints = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return prints, [find(i) for i in range(len(rows))]


def one_of_each(rows, radius=2):
    """(doc_id, fingerprint) of the row of each component with the smallest id."""
    prints, roots = simhash_roots(rows, radius)
    best = {}
    for i, r in enumerate(roots):
        best[r] = min(best.get(r, (True, 0, i)), (rows[i][0] is None, rows[i][0] or 0, i))
    return sorted((-1 if rows[i][0] is None else rows[i][0], f"{prints[i]:016x}") for _, _, i in best.values())


def simhash_components(rows):
    prints, roots = simhash_roots(rows)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = roots[i]
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((-1 if d is None else d, f"{p:016x}", -1 if least[roots[i]] is None else least[roots[i]]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def contamination(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = letter_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for d, text in rows:
        w, hit, met = letter_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        names = sorted(str(m) for m in met if m is not None)
        out.append((-1 if d is None else d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def quality_counts(text):
    w = blank_words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {i + j for i in range(len(w) - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked))
    return (*counts, len(w) < 50 or 100 * len(marked) > 50 * len(w))


def cut_lines(rows, run=50):
    """rows: (doc_id, text), documents in the order of places; rows that are equal are one document.

    Runs of lines that have ``run`` words: the shortest from each line with words on, and the shortest up to each.
    """
    seen, gone = set(), {}
    for key in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, cut = [tuple(BLANK.findall(x)) for x in key[1].split("\n")], set()
        runs = set()
        for k in (k for k, x in enumerate(lines) if x):
            ends = [e for e in range(k + 1, len(lines) + 1) if sum(map(len, lines[k:e])) >= run]
            starts = [s for s in range(k + 1) if lines[s] and sum(map(len, lines[s : k + 1])) >= run]
            runs |= {(k, e) for e in ends[:1]} | {(s, k + 1) for s in starts[-1:]}
        for start, end in sorted(runs):
            window = tuple(x for x in lines[start:end] if x)
            if window in seen:
                cut.update(range(start, end))
            seen.add(window)
        gone[key] = cut
    return {key: "\n".join(x for i, x in enumerate(key[1].split("\n")) if i not in cut) for key, cut in gone.items()}


def base_scores(rows, held=7, rest=2):
    tokens = [(d, BLANK.findall((t or "").translate(AZ)) + ["\n"]) for d, t in rows]
    c = Counter(w for d, ws in tokens if crc(d, held) != rest for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((-1 if d is None else d, crc(d, held) == rest, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens)


def fit_bags(bags, labels, weights, buckets, classes, dim, epochs, rate, scale, batch, decay, pad):
    """A linear softmax over averaged embeddings by Adam, in whole matrices; only rows that a batch uses move."""
    rng = np.random.default_rng(1)
    emb, out, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.1, (dim, classes)), np.zeros(classes)
    x = np.zeros((len(bags), buckets))
    for i, (b, n) in enumerate(bags):
        x[i, b] = n / max(1, n.sum() + pad) * scale
    rng, step = np.random.default_rng(2), 0
    params = [emb, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            now = order[k : k + batch]
            step += 1
            mean = x[now] @ params[0]
            p = np.exp(mean @ params[1] + params[2])
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(classes)[labels[now]]) * weights[labels[now]][:, None] / len(now)
            grads = [x[now].T @ (error @ params[1].T) + decay * params[0], mean.T @ error, error.sum(0)]
            used = [np.flatnonzero(x[now].any(0)), slice(None), slice(None)]
            for j, (g, u) in enumerate(zip(grads, used, strict=True)):
                first[j][u] = 0.9 * first[j][u] + 0.1 * g[u]
                second[j][u] = 0.999 * second[j][u] + 0.001 * g[u] ** 2
                params[j][u] -= rate * (1 - epoch / epochs) * first[j][u] / (1 - 0.9**step) / (np.sqrt(second[j][u] / (1 - 0.999**step)) + 1e-8)
    return params[0] @ params[1] * scale, params[2]


def byte_tree(bodies, depth, p_min, gamma, ratio, pull):
    """The kept byte contexts and their next-byte distributions, in dictionaries; b"" is the root."""
    follow = defaultdict(Counter)
    for body in bodies:
        data = b"\n" * depth + body
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                follow[data[i - d : i]][data[i]] += 1
    total = sum(follow[b""].values())
    least = max(1.0, p_min * total)
    level = {c for c in follow if len(c) == 1 and sum(follow[c].values()) >= least}
    kept = {b"": {x: (follow[b""][x] + 1) / (total + 256) for x in range(256)}}
    for _ in range(depth):
        new = {}
        for c in level:
            base = next(kept[c[k:]] for k in range(1, len(c) + 1) if c[k:] in kept)
            n = sum(follow[c].values())
            smooth = {x: (follow[c][x] + pull * base[x]) / (n + pull) for x in range(256)}
            raw = {x: follow[c][x] / max(n, 1) for x in range(256)}
            change = {x: (raw[x] or smooth[x]) / base[x] for x in range(256)}
            met = {x for b in bodies for x in b} | {10}
            if any((raw[x] >= gamma or base[x] >= gamma) and (change[x] >= ratio or change[x] <= 1 / ratio) for x in met):
                new[c] = smooth
        kept |= new
        level = {c + bytes([x]) for c in level for x, n in follow[c].items() if n >= least and (c + bytes([x]))[1:] in level}
    return kept


def tree_scores(rows, m, long=True):
    """(doc_id, held_out, score) by both tiers; ``m`` has the constants and the hash that lets long contexts in."""
    az = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    docs = [(-1 if d is None else d, crc(d, 7) == 2, b" ".join((t or "").encode().translate(az).split()) + b"\n") for d, t in rows]
    kept = byte_tree([b for _, h, b in docs if not h], m.DEPTH, m.P_MIN, m.GAMMA, m.RATIO, m.PULL)

    def words(body):
        """(word with what ends it, its log10 by bytes) in order."""
        data, out, start, log = b"\n" * m.DEPTH + body, [], m.DEPTH, 0.0
        for i in range(m.DEPTH, len(data)):
            context = next(data[i - d : i] for d in range(m.DEPTH, -1, -1) if data[i - d : i] in kept)
            log += math.log10(kept[context][data[i]])
            if data[i] in b" \n":
                out.append((data[start : i + 1], log))
                start, log = i + 1, 0.0
        return out

    def admitted(context):
        data = np.frombuffer(context, "u1")
        return m.Hashes(data).of(np.array([0]), np.array([len(data)]))[0] % m.ANCHOR == 0

    each = [words(b) for _, _, b in docs]
    after = defaultdict(lambda: defaultdict(list))
    for (_, held, _), ws in zip(docs, each, strict=True):
        for i in range(m.WORDS, len(ws)):
            context = b"".join(w for w, _ in ws[i - m.WORDS : i])
            if not held and admitted(context):
                after[context][ws[i][0]].append(ws[i][1])
    tables = {}
    for context, nexts in after.items():
        n = sum(map(len, nexts.values()))
        if n >= 2 and sum(len(x) * math.log10(len(x) / n) - sum(x) for x in nexts.values()) >= m.GAIN:
            tables[context] = (n, len(nexts), {w: len(x) for w, x in nexts.items()})
    out = []
    for (d, held, _), ws in zip(docs, each, strict=True):
        score = 0.0
        for i, (w, log) in enumerate(ws):
            table = tables.get(b"".join(x for x, _ in ws[i - m.WORDS : i])) if long and i >= m.WORDS else None
            score += math.log10((table[2].get(w, 0) + table[1] * 10**log) / (table[0] + table[1])) if table else log
        out.append((d, held, score))
    return out
