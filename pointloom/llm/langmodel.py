"""Language-model scoring by a probabilistic suffix tree, beside add-one word unigrams.

A text is lower-cased (A-Z), its words are joined by single blanks, and one end symbol closes it; it begins after end
symbols. The tree has two tiers:

* Short contexts are bytes, up to ``DEPTH``. They are grown level by level, each level counted over all training documents: a
  context is a candidate if it makes up ``P_MIN`` of all symbols, so no level has more than ``1 / P_MIN`` of them and the
  table that executors hold has at most ``DEPTH / P_MIN`` rows of 257 numbers, whatever the corpus. A candidate is kept if
  some next byte of probability ``GAMMA`` or more is ``RATIO`` times likelier, or rarer, after it than after its
  longest kept suffix. Distributions are smoothed towards that suffix's, down to the root, which is smoothed by one
  count for each byte.
* Long contexts are the ``WORDS`` words before a word, and predict that word. They are as many as the corpus has: every place of
  every text is packed and shuffled once, to the group of its context, where counts, pruning and scores are made. A long context is kept if it occurs twice or more and its next words' distribution diverges from the
  byte tree's: occurrences times divergence is ``GAIN`` or more, in log10. With n of N occurrences followed by the word,
  and t different words, the word has (n + t * bytes' probability) / (N + t).

A word is scored by the longest kept suffix: the long context, or else byte by byte.

Word counts for the base score grow with the corpus and stay distributed. Words that make up ``HEAD`` of all
tokens, at most ``1 / HEAD`` of them, are scored where the text lies; the others, counted once a document, meet
their counts as places meet their contexts. So frequent words, the skewed keys, are never shuffled. Words and contexts are told apart by
64-bit hashes, a long context's next words by 32 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import LOWER, UPPER, crc_mod, discard, map_arrow, table, tidy, written

DEPTH, P_MIN, GAMMA, RATIO, PULL = 5, 1e-5, 1e-3, 1.2, 60.0
WORDS, GAIN = 3, 1.0
#: Long contexts whose hash this divides may enter: all.
ANCHOR = 1
#: Steps in which a word's log10 is kept beside its hash; 32 bits of them reach to words of tens of kilobytes, longer ones are left to the bytes.
STEP = 1 << 14
#: Counts that a pass may gather; two levels are counted at once if they keep within it.
CELLS = 8_000_000
HEAD = 1e-5
#: Places that a task puts in order at once; training tokens to a group of contexts, of which there are 2 ** LEAST_BITS or more, and to a task that has groups.
WAIT, GROUP, LEAST_BITS, TASK = 1 << 20, 1 << 21, 9, 4_000_000
#: How a plane of bytes is kept (0: it is all zeros), and how many of its bytes show whether zstd is worth trying.
RAW, ZSTD, PROBE = 1, 2, 4096
SLICE, FLUSH = 1 << 20, 150_000
#: Words that places may have by number, not by hash: as many as a task of the first counts names, and as there are at last. No result depends on them.
COMMON, NONE = 4095, np.zeros(0, "u4")
END = b"\n"
_AZ = bytes.maketrans(UPPER.encode(), LOWER.encode())


def tokens_of(text: str | None) -> list[bytes]:
    """The contract's words, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_AZ).split()


def keys_of(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", n).view("i8")


def slices(bodies: Sequence[bytes], depth: int, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(bytes, which are predicted, starts, numbers): bodies behind ``depth`` bytes of context, long ones in several parts."""
    parts, lengths, numbers, size = [], [], [], 0

    def out():
        data = np.frombuffer(b"".join(parts), "u1")
        starts = np.cumsum([0, *lengths])
        told = np.ones(len(data), bool)
        told[(starts[:-1, None] + np.arange(depth)).ravel()] = False
        return data, told, starts[:-1], numbers

    for i, body in enumerate(bodies):
        before = END * depth
        for a in range(0, len(body), limit):
            part = before + body[a : a + limit]
            if parts and size + len(part) > limit:
                yield out()
                parts, lengths, numbers, size = [], [], [], 0
            parts.append(part)
            lengths.append(len(part))
            numbers.append(i)
            size += len(part)
            before = part[-depth:]
    if parts:
        yield out()


class Levels:
    """Candidate contexts. ``tables[d - 1]`` leads from a context of length d - 1 and the symbol before it to that of length d; 0 is none."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.size = symbols, int(symbols.max()) + 1
        self.tables: list[np.ndarray] = []

    def walk(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """For each length from 1, the context that ends before each byte."""
        sym = self.symbols[data]
        at = np.zeros(len(sym), "i4")
        for d, step in enumerate(self.tables, 1):
            at *= self.size
            at[d:] += sym[:-d]
            at = np.take(step, at, mode="clip")
            at[:d] = 0
            yield at


class Tree(NamedTuple):
    levels: Levels
    states: list[np.ndarray]  # by length: the longest kept suffix of each candidate
    log10: np.ndarray  # states x symbols


class Hashes:
    """64-bit hashes of any stretches of some bytes: differences of prefix sums, brought to the same power and mixed."""

    BASE = 0x9E3779B97F4A7C15
    powers = inverse = np.ones(1, "u8")

    def __init__(self, data: np.ndarray):
        if len(Hashes.powers) <= len(data):
            n = 2 * len(data)
            Hashes.powers, Hashes.inverse = (np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, x, "u8")])) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(self.mixed(np.arange(1, 257, dtype="u8"))[data] * self.powers[: len(data)], out=self.sums[1:])

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


class Places(NamedTuple):
    """Words behind a long context: number of the text, context, and the word: 32 bits of hash, 32 of its -log10 by bytes."""

    number: np.ndarray
    context: np.ndarray
    word: np.ndarray

    @staticmethod
    def none() -> Places:
        return Places(*(np.zeros(0, "i8") for _ in range(3)))


class Tail(NamedTuple):
    """The last words of a slice, for the next one if the text goes on there: number of the text, bytes, and their log10."""

    number: int
    data: np.ndarray
    logs: np.ndarray


def places_of(data: np.ndarray, told: np.ndarray, starts: np.ndarray, numbers: Sequence[int], logs: np.ndarray, before: Tail | None = None) -> tuple[Places, Tail]:
    """Of all words that have ``WORDS`` words before them in their text. A word ends with the blank or end behind it."""
    lead, skip = np.full(len(starts), DEPTH), 0
    if before is not None and before.number == numbers[0]:  # a text that goes on: its last words in place of the context
        lead[0], skip = 0, len(before.data)
        data, logs = np.concatenate([before.data, data[DEPTH:]]), np.concatenate([before.logs, logs[DEPTH:]])
        told = np.concatenate([np.ones(skip, bool), told[DEPTH:]])
        starts = np.concatenate([[0], starts[1:] + (skip - DEPTH)])
    ends = np.flatnonzero(told & ((data == 32) | (data == END[0])))
    part = np.searchsorted(starts, ends, "right") - 1
    own = ends[part == len(starts) - 1]
    since = own[-WORDS - 1] + 1 if len(own) > WORDS else starts[-1] + lead[-1]
    tail = Tail(numbers[-1], data[since:].copy(), logs[since:].copy())
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    begins = np.maximum(begins, starts[part] + lead[part])  # a text's first word begins behind its context
    n = len(ends) - WORDS
    if n <= 0:
        return Places.none(), tail
    whole = np.flatnonzero((part[WORDS:] == part[:n]) & (ends[WORDS:] >= skip))
    hashes = Hashes(data)
    context, word = hashes.of(begins[whole], ends[whole + WORDS - 1] + 1), whole + WORDS
    total = np.concatenate([[0.0], np.cumsum(logs, dtype="f8")])
    steps = np.rint((total[begins[word]] - total[ends[word] + 1]) * STEP).astype("i8")
    follow = hashes.of(begins[word], ends[word] + 1) & np.uint64(0xFFFFFFFF00000000)
    places = Places(np.asarray(numbers, "i8")[part[word]], context.view("i8"), follow.view("i8") | steps)
    return Places(*(x[steps < 1 << 32] for x in places)), tail


def score_bodies(tree: Tree, bodies: Sequence[bytes]) -> tuple[np.ndarray, Places]:
    """log10 of each body by bytes, and the words that long contexts may predict instead, in the order of the bodies."""
    out, places, tail = np.zeros(len(bodies)), [], None
    for data, told, starts, numbers in slices(bodies, DEPTH):
        state = np.zeros(len(data), "i4")
        for at, states in zip(tree.levels.walk(data), tree.states, strict=True):
            np.maximum(state, np.take(states, at, mode="clip"), out=state)  # a longer suffix has the larger number, 0 is the root
        state *= tree.levels.size
        state += tree.levels.symbols[data]
        logs = np.take(tree.log10, state, mode="clip") * told
        np.add.at(out, numbers, np.add.reduceat(logs, starts, dtype="f8"))
        found, tail = places_of(data, told, starts, numbers, logs, tail)
        places.append(found)
    return out, Places(*(np.concatenate(x) for x in zip(*places, strict=True))) if places else Places.none()


def bodies_of(texts: pa.Array) -> list[bytes]:
    return [b" ".join(tokens_of(t.as_py())) + END for t in texts]


def most_common(words: Counter) -> tuple[np.ndarray, list[int]]:
    """32 bits of the hashes of the most frequent words with a blank behind them, and their counts."""
    few = [(w, n) for w, n in words.most_common(COMMON + 1) if w != END][:COMMON]
    data = np.frombuffer(b"".join(w + b" " for w, _ in few), "u1")
    ends = np.flatnonzero(data == 32) + 1
    begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
    return (Hashes(data).of(begins, ends) >> np.uint64(32)).view("i8"), [n for _, n in few]


def first_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): 0 for words by hash, 1 for pairs of bytes; each task's sums, words flushed in bounded parts.

    Of a task's first part, kind 2 has the ``COMMON`` most frequent words as places have them: 32 bits of hash, a blank behind them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs = np.zeros(65536, "i8")
        named = False

        def rows(kind: int, keys, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, "i4")), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                split = [tokens_of(t.as_py()) for t in batch.column(0).slice(start, 500)]
                for w in split:
                    words.update(w)
                words[END] += len(split)
                for data, told, _, _ in slices([b" ".join(w) + END for w in split], 1):
                    code = data[:-1].astype("i4") * 256 + data[1:]
                    pairs += np.bincount(code[told[1:]], minlength=65536)
                if len(words) > FLUSH:
                    if not named:
                        yield rows(2, *most_common(words))
                        named = True
                    yield rows(0, keys_of(words, len(words)), list(words.values()))
                    words.clear()
        if not named:
            yield rows(2, *most_common(words))
        yield rows(0, keys_of(words, len(words)), list(words.values()))
        used = np.flatnonzero(pairs)
        yield rows(1, used, pairs[used])

    return map_arrow(docs.select(F.col("text").cast("string")), run, "kind int, key long, n long")


def level_counts(docs: DataFrame, levels: Levels, last: int) -> list[np.ndarray]:
    """Counts of (context, next symbol) for the ``last`` levels, over all ``docs``: ``CELLS`` numbers or fewer."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    sizes = [(int(t.max()) + 1) * levels.size for t in levels.tables[-last:]]
    starts = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Levels = shared.value
        tally = Tally(known, starts)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for data, told, _, _ in slices(bodies_of(batch.column(0).slice(start, 500)), DEPTH):
                    tally.add(data, told)
        total = tally.settle()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["key", "n"])

    got = map_arrow(docs.select(F.col("text").cast("string")), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(starts[-1], "i8")
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return [out[a:b].reshape(-1, levels.size) for a, b in zip(starts, starts[1:], strict=False)]


class Tally:
    """Sums of (context, next symbol) pairs of the last levels. Pairs wait until they are many, since each count costs a pass over the cells."""

    WAIT = 4 << 20

    def __init__(self, levels: Levels, starts: np.ndarray):
        self.levels, self.first = levels, len(levels.tables) - len(starts) + 1
        self.sizes, self.total = np.diff(starts), np.zeros(starts[-1], "i8")
        self.parts = np.split(self.total, starts[1:-1])
        self.waiting: list[list[np.ndarray]] = [[] for _ in self.sizes]

    def add(self, data: np.ndarray, told: np.ndarray) -> None:
        sym = self.levels.symbols[data]
        for d, at in enumerate(self.levels.walk(data)):
            if d >= self.first:
                self.waiting[d - self.first].append(at * told * self.levels.size + sym)  # 0: no context, or not predicted
        if sum(map(len, self.waiting[0])) > self.WAIT:
            self.settle()

    def settle(self) -> np.ndarray:
        for part, size, codes in zip(self.parts, self.sizes, self.waiting, strict=True):
            if codes:
                part += np.bincount(np.concatenate(codes), minlength=size)
                part[: self.levels.size] = 0
                codes.clear()
        return self.total


def grow(docs: DataFrame, pairs: np.ndarray, depth: int = DEPTH, p_min: float = P_MIN) -> tuple[Levels, list[np.ndarray]]:
    """Candidates of all lengths and their next-symbol counts. ``pairs``: 256 x 256 counts of (byte before, byte).

    A pass over the documents counts two levels. The contexts of the first are known: frequent strings, found
    as contexts with next symbols in the pass before. Of the second, those strings are counted whose prefix and suffix are
    among the first's, as every frequent one's are; the rare ones are dropped when the counts are there.
    """
    seen = (pairs.sum(0) > 0) | (pairs.sum(1) > 0)
    levels = Levels(np.where(seen, np.cumsum(seen), 0).astype("i4"))  # 0: a byte never met
    symbols, size = levels.symbols, levels.size
    least = max(1.0, p_min * pairs.sum())
    first = np.zeros((size, size), "i8")
    np.add.at(first, (symbols[:, None].repeat(256, 1), symbols[None].repeat(256, 0)), pairs)
    counts = [first.sum(0, keepdims=True)]

    def enter(strings: list[tuple], before: dict[tuple, int]) -> dict[tuple, int]:
        """A new level of these strings; ``before`` has the numbers of the level below."""
        table = np.zeros((len(before) + 1) * size, "i4")
        for i, s in enumerate(strings, 1):
            table[before[s[1:]] * size + s[0]] = i
        levels.tables.append(table)
        return {s: i for i, s in enumerate(strings, 1)}

    def longer(strings: list[tuple], follow: np.ndarray, known: dict[tuple, int]) -> list[tuple]:
        """Frequent strings one symbol longer whose suffix is known."""
        return [s for c, n in zip(*np.nonzero(follow >= least), strict=True) if (s := (*strings[c - 1], int(n)))[1:] in known]

    strings = [(int(s),) for s in np.flatnonzero(first.sum(1) >= least) if s]
    if not strings:
        return levels, counts
    table = np.zeros(size, "i4")
    table[[s[0] for s in strings]] = np.arange(1, len(strings) + 1)
    levels.tables.append(table)
    known = {s: i for i, s in enumerate(strings, 1)}
    counts.append(np.concatenate([np.zeros((1, size), "i8"), first[[s[0] for s in strings]]]))
    while len(levels.tables) < depth and (new := longer(strings, counts[-1], known)):
        now = enter(new, known)
        by_prefix: dict[tuple, list[tuple]] = {}
        for s in new:
            by_prefix.setdefault(s[:-1], []).append(s)
        guesses = [(*t, s[-1]) for t in new for s in by_prefix.get(t[1:], ())]
        both = guesses and len(levels.tables) < depth and (len(new) + len(guesses) + 2) * size <= CELLS
        if not both:
            strings, known = new, now
            counts += level_counts(docs, levels, 1)
            continue
        enter(guesses, now)
        one, two = level_counts(docs, levels, 2)
        levels.tables.pop()
        kept = [i for i, s in enumerate(guesses, 1) if one[now[s[:-1]], s[-1]] >= least]
        strings = [guesses[i - 1] for i in kept]
        counts.append(one)
        if not strings:
            break
        known = enter(strings, now)
        counts.append(np.concatenate([np.zeros((1, size), "i8"), two[kept]]))
    return levels, counts


def prune(levels: Levels, counts: list[np.ndarray], gamma: float = GAMMA, ratio: float = RATIO, pull: float = PULL) -> Tree:
    """The kept contexts and their smoothed distributions."""
    size, met = levels.size, np.flatnonzero(np.bincount(levels.symbols, minlength=levels.size))
    missing = 256 - (len(met) - (0 in met))  # bytes never met share symbol 0
    root = counts[0][0].astype("f8") + 1
    root[0] = 1.0  # of each of them
    probs, states = [root / (root[1:].sum() + missing)], []
    suffix = np.zeros(1, "i4")
    for d, follow in enumerate(counts[1:], 1):
        step = levels.tables[d - 1]
        parent = np.zeros(len(follow), "i4")
        used = np.flatnonzero(step)
        parent[step[used]] = used // size
        state = suffix[parent]
        base = np.stack(probs)[state]
        n = follow.sum(1, keepdims=True)
        smooth = (follow + pull * base) / (n + pull)
        raw = follow / np.maximum(n, 1)
        change = np.where(raw > 0, raw, smooth) / base
        keep = (((raw >= gamma) | (base >= gamma)) & ((change >= ratio) | (change <= 1 / ratio))).any(1)
        keep[0] = False
        state = state.copy()
        state[keep] = len(probs) + np.arange(keep.sum())
        probs += list(smooth[keep])
        states.append(state)
        suffix = state
    return Tree(levels, states, np.log10(np.stack(probs)).astype("f4").ravel())


def train(docs: DataFrame, vocab: DataFrame, pairs: np.ndarray) -> tuple[Tree, tuple]:
    """The tree, and the words' totals: (tokens, words, hashes of frequent words, log10 of their counts + 1)."""
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = vocab.where(F.col("n") >= F.lit(max(1.0, HEAD * n))).orderBy("key").toArrow()  # at most 1 / HEAD rows
    tree = prune(*grow(docs, pairs))
    return tree, (int(n), int(v), head["key"].to_numpy(), np.log10(head["n"].to_numpy() + 1.0))


def squeezed(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> Iterator[bytes]:
    """Of each part, the numbers between two edges of every column: planes of bytes, those of zeros left out, the others raw or by zstd, whichever is shorter.

    Whether zstd is tried is seen from a plane's first bytes in all parts. A part begins with two bits for each plane and the sizes of those by zstd.
    """
    zstd = pa.Codec("zstd", compression_level=1)
    planes = [x for c in columns for x in np.ascontiguousarray(c.view("u1").reshape(len(c), c.itemsize).T)]
    ends = [e.tolist() for c, e in zip(columns, edges, strict=True) for _ in range(c.itemsize)]
    used = [(2 * i, bytes(x), e, len(zstd.compress(few := x[:PROBE], asbytes=True)) < 0.98 * len(few)) for i, (x, e) in enumerate(zip(planes, ends, strict=True)) if x.any()]
    for k in range(len(ends[0]) - 1):
        modes, sizes, parts = 0, [], []
        for at, plane, e, dense in used:
            x = plane[e[k] : e[k + 1]]
            if not dense:
                modes |= RAW << at
            elif x.count(0) == len(x):
                continue
            elif len(z := zstd.compress(x, asbytes=True)) + 4 < len(x):
                modes |= ZSTD << at
                sizes.append(len(z))
                x = z
            else:
                modes |= RAW << at
            parts.append(x)
        yield b"".join([modes.to_bytes((len(planes) + 3) // 4, "little"), np.array(sizes, "u4").tobytes(), *parts])


def spread(packed: bytes, lengths: Sequence[int | Callable], widths: Sequence[int]) -> list[np.ndarray]:
    """The unsigned numbers of a part again: of each column how many, or how that follows from the columns before, and of how many bytes."""
    head = (sum(widths) + 3) // 4
    modes = [packed[i // 4] >> i % 4 * 2 & 3 for i in range(sum(widths))]
    sizes = iter(np.frombuffer(packed, "u4", modes.count(ZSTD), head).tolist())
    at, planes, out = head + 4 * modes.count(ZSTD), iter(modes), []
    for n, width in zip(lengths, widths, strict=True):
        n = n if isinstance(n, int) else n(out)
        column = np.zeros((n, width), "u1")
        for k, mode in zip(range(width), planes):  # noqa: B905
            if mode:
                x = packed[at : (at := at + (n if mode == RAW else next(sizes)))]
                column[:, k] = np.frombuffer(x if mode == RAW else pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True), "u1")
        out.append(column.view(f"u{width}").ravel())
    return out


class Pack:
    """Places on their way to the task that has all of their context, about 11 bytes each. Words, with how often a row or the corpus has them, go the same way.

    Contexts are dealt over groups by their first bits. ``WAIT`` places are put in order together; those of a group are one row:
    equal ones counted, a context once, as its difference from the one before, a word once behind a context, by number if it is one of ``common``
    (most frequent first), and all numbers as planes of bytes.
    """
    def __init__(self, bits: int, kind: int, common: np.ndarray = NONE):
        self.bits, self.kind, self.size, self.first = bits, kind, 0, 0
        self.common, self.numbers = np.concatenate([np.zeros(1, "u4"), common]), np.zeros(1 << 16, "u2")
        self.numbers[common[::-1] >> np.uint32(16)] = np.arange(len(common), 0, -1)  # of two in one place the more frequent
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, who: np.ndarray, context: np.ndarray, word: np.ndarray) -> None:
        """``who``: twice the row of each place, and 1 for held-out rows; rows ascend."""
        if len(who):
            self.first = self.first if self.size else int(who[0]) // 2
            self.waiting.append(((who - 2 * self.first).astype("u4"), context.view("u8"), word.view("u8")))
            self.size += len(who)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Rows of ``_PACKED``: group, kind, the first row, places, what ``unpacked`` reads; the other columns are null."""
        rows = list(self.rows())
        for a in range(0, len(rows), 64):
            given = [pa.array(x, t) for x, t in zip(zip(*rows[a : a + 64], strict=True), _TYPES, strict=False)]
            yield pa.RecordBatch.from_arrays([*given, *[pa.nulls(len(given[0]), t) for t in _TYPES[len(given) :]]], _NAMES)

    def rows(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        if not self.size:
            return
        who, context, word = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        order = np.argsort(context, kind="stable")
        who, context, word = who[order], context[order], word[order]
        new = np.concatenate([[True], context[1:] != context[:-1], [True]])
        several = np.flatnonzero(~(new[:-1] & new[1:]))  # of contexts that occur again: by word
        order = several[np.lexsort((word[several], context[several]))]
        who[several], word[several] = who[order], word[order]
        kind = new[:-1].astype("u1") + np.concatenate([[True], new[1:-1] | (word[1:] != word[:-1])])  # 2: a context, 1: a word that it has not had
        fresh = np.flatnonzero(np.concatenate([[True], (kind[1:] > 0) | (who[1:] != who[:-1])]))
        times = np.diff(fresh, append=len(context)).astype("u4") - np.uint32(1)
        kind, who = kind[fresh], who[fresh]
        of_context, of_word = np.flatnonzero(kind == 2), np.flatnonzero(kind)
        context, word = context[fresh[of_context]], word[fresh[of_word]]
        group = (context >> np.uint64(64 - self.bits)).astype("i8")
        contexts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        step = np.diff(context, prepend=context[:1])
        step[contexts[:-1]] = 0
        places = np.append(of_context, len(kind))[contexts]
        words = np.searchsorted(of_word, places)
        follow, low = (word >> np.uint64(32)).astype("u4"), word.astype("u4")
        number = self.numbers[follow >> np.uint32(16)]
        number[self.common[number] != follow] = 0
        other = np.flatnonzero(number == 0)
        others = np.searchsorted(other, words)
        parts = squeezed((kind, step, number, follow[other], low, who, times), (places, contexts, words, others, words, places, places))
        heads = np.stack([context[contexts[:-1]], np.diff(contexts).astype("u8") << np.uint64(32) | np.diff(words).astype("u8")], 1)
        for at, n, head, part in zip(group[contexts[:-1]].tolist(), np.diff(places).tolist(), heads, parts, strict=True):
            yield at, self.kind, self.first, n, head.tobytes() + part

    @staticmethod
    def unpacked(first: int, n: int, packed: bytes, common: np.ndarray = NONE) -> tuple[np.ndarray, ...]:
        """who, context, word, times."""
        context, sizes = np.frombuffer(packed, "u8", 2)
        contexts, words = int(sizes) >> 32, int(sizes) & 0xFFFFFFFF
        kind, step, number, follow, low, who, times = spread(packed[16:], (n, contexts, words, lambda x: np.count_nonzero(x[2] == 0), words, n, n), (1, 8, 2, 4, 4, 4, 4))
        step[0] = context
        word = np.concatenate([np.zeros(1, "u4"), common])[number].astype("u8")
        word[number == 0] = follow
        word = word << np.uint64(32) | low
        context, word = np.cumsum(step, dtype="u8")[np.cumsum(kind == 2) - 1], word[np.cumsum(kind > 0) - 1]
        return who.astype("i8") + 2 * first, context, word, times.astype("i8") + 1


_PACKED = "part int, kind int, first long, places int, packed binary"
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head double, score double"
_NAMES = [f.split()[0] for f in f"{_PACKED}, {_SCORED}".split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
PLACES, RARE, VOCABULARY = range(3)


def packed_words(vocab: DataFrame, bits: int) -> DataFrame:
    """(key, n) as rows of ``Pack``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack(bits, VOCABULARY)
        for batch in batches:
            pack.add(np.zeros(batch.num_rows, "i8"), batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if pack.size >= WAIT:
                yield from pack.settle()
        yield from pack.settle()

    return map_arrow(vocab.select("key", "n"), run, f"{_PACKED}, {_SCORED}")


def scored(docs: DataFrame, model: tuple[Tree, tuple], bits: int, common: np.ndarray) -> DataFrame:
    """Per row of ``docs`` (row, doc_id, held_out, text): token counts and scores.

    Beside them, by ``part``, what is left to meet: rows of ``Pack`` with the places of long contexts, and with the words that aren't frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*model, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (_, _, head, logs), common = shared.value
        packs = Pack(bits, PLACES, common), Pack(bits, RARE)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                split = [tokens_of(t.as_py()) for t in batch.column(3)]
                found = [Counter(w) for w in split]
                for c in found:
                    c[END] = 1
                sizes = np.array([len(c) for c in found])
                keys = keys_of(chain.from_iterable(found), sizes.sum())
                times = np.fromiter(chain.from_iterable(c.values() for c in found), "i8", sizes.sum())
                doc = np.repeat(np.arange(len(split)), sizes)
                at = np.searchsorted(head, keys).clip(max=max(0, len(head) - 1))
                known = head[at] == keys if len(head) else np.zeros(len(keys), bool)
                count = lambda x: np.bincount(doc[known], x, len(split))
                rest = ~known
                score, places = score_bodies(tree, [b" ".join(w) + END for w in split])
                row, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                who = row * 2 + held
                packs[0].add(who[places.number], places.context, places.word)
                packs[1].add(who[doc[rest]], keys[rest], times[rest])
                own = [pa.array(row & ((1 << bits) - 1), pa.int32()), *[pa.nulls(len(split), t) for t in _TYPES[1:5]]]
                yield pa.RecordBatch.from_arrays(
                    [*own, *[batch.column(k) for k in range(3)], pa.array([len(w) + 1 for w in split], pa.int64()), pa.array(count(times[known]).astype("i8")), pa.array(count(times[known] * logs[at[known]] if len(head) else None).astype("f8")), pa.array(score)],
                    _NAMES,
                )
                for pack in packs:
                    if pack.size >= WAIT:
                        yield from pack.settle()
        for pack in packs:
            yield from pack.settle()

    return map_arrow(docs, run, f"{_PACKED}, {_SCORED}")


def gains(who: np.ndarray, context: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gain): what the kept ones of these contexts add to the byte tree's score. All places of each context must be there."""
    order = np.argsort(context, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(context[order]) != 0]))
    sizes, learnt = np.diff(begins, append=len(context)), np.where(who % 2 == 0, times, 0)
    n = np.add.reduceat(learnt[order], begins)
    often = n >= 2
    order, n = order[np.repeat(often, sizes)], n[often].astype("f8")
    if not len(n):
        return np.zeros(0, "i8"), np.zeros(0)
    which, follow = np.repeat(np.arange(len(n)), sizes[often]), word[order] >> np.uint64(32)
    again = np.argsort(which.astype("u8") << np.uint64(32) | follow, kind="stable")
    order, which, follow = order[again], which[again], follow[again]
    who, times, learnt = who[order], times[order], learnt[order]
    log = -(word[order] & np.uint64(0xFFFFFFFF)).astype("f8") / STEP
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(follow) != 0)]))
    n_next, of = np.add.reduceat(learnt, begins).astype("f8"), which[begins]
    met = np.maximum(n_next, 1)
    diverges = np.bincount(of, n_next * np.log10(met / n[of]), len(n)) - np.bincount(which, learnt * log, len(n))
    kinds = np.bincount(of, n_next > 0, len(n))
    kept = (diverges >= GAIN)[which]
    n_next = np.repeat(n_next, np.diff(begins, append=len(which)))[kept]
    which, log = which[kept], log[kept]
    share = (n_next + kinds[which] * 10.0**log) / (n[which] + kinds[which])
    row, at = np.unique(who[kept] // 2, return_inverse=True)
    return row, np.bincount(at, times[kept] * (np.log10(share) - log), len(row))


def rare(who: np.ndarray, key: np.ndarray, times: np.ndarray, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n_tail, tail): of these words, how many are known, and the sum of log10(n + 1)."""
    order = np.argsort(known)
    known, n = known[order], n[order]
    at = np.searchsorted(known, key).clip(max=max(0, len(known) - 1))
    found = known[at] == key if len(known) else np.zeros(len(key), bool)
    row, to = np.unique(who[found] // 2, return_inverse=True)
    return row, np.bincount(to, times[found], len(row)), np.bincount(to, times[found] * np.log10(n[at[found]] + 1.0), len(row))


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(row, sums ..) of some."""
    of, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows, at = np.unique(of, return_inverse=True)
    return rows, *(np.bincount(at, x, len(rows)) for x in values)


class Sums:
    """(row, gain, n_tail, tail) in rows of ``_SUMS``, by the row's remainder.

    Of a row there is what its remainder leaves open; of sums, only those that aren't 0, in 2 ** -32. A short tail, the sum of a few
    words' log10, is the product of these words' numbers.
    """

    PART, SHORT = 33, 2.0**31  # as monotonically_increasing_id has the task in a row's number

    @staticmethod
    def packed(tasks: int, row: np.ndarray, gain: np.ndarray, n_tail: np.ndarray, tail: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.lexsort((row, row % tasks))
        bucket, row, tail = (row % tasks)[order], row[order], tail[order]
        gain, n_tail, exact = (np.rint(x).astype("i8") for x in (gain[order] * 2.0**32, n_tail[order], tail * 2.0**32))
        product = np.rint(10.0 ** np.minimum(tail, 10))
        short = (tail > 0) & (product < Sums.SHORT) & (np.rint(np.log10(product) * 2.0**32) == exact)
        kind = ((gain != 0) + 2 * short + 4 * ((exact != 0) & ~short)).astype("u1")
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        part, at = row >> Sums.PART, (row & ((1 << Sums.PART) - 1)) // tasks
        steps = [np.diff(x, prepend=0) for x in (part, at)]
        for step, x in zip(steps, (part, at), strict=True):
            step[edges[:-1]] = x[edges[:-1]]
        given = [np.flatnonzero(kind & bit) for bit in (1, 2, 4)]
        columns = [kind, *((x << 1) ^ (x >> 63) for x in (*steps, n_tail, gain[given[0]])), product[given[1]].astype("u4"), exact[given[2]]]
        parts = squeezed(columns, [*[edges] * 4, *(np.searchsorted(x, edges) for x in given)])
        for a, b, data in zip(edges[:-1], edges[1:], parts, strict=True):
            yield int(bucket[a]), int(b - a), tasks.to_bytes(4, "little") + data

    @staticmethod
    def unpacked(bucket: int, n: int, packed: bytes) -> tuple[np.ndarray, ...]:
        tasks = int.from_bytes(packed[:4], "little")
        given = [lambda x, bit=bit: np.count_nonzero(x[0] & bit) for bit in (1, 2, 4)]
        kind, *whole, product, exact = spread(packed[4:], (*[n] * 4, *given), (1, 8, 8, 8, 8, 4, 8))
        part, at, n_tail, some = ((x >> np.uint64(1)).view("i8") ^ -(x & np.uint64(1)).view("i8") for x in whole)
        gain, tail = np.zeros(n, "i8"), np.zeros(n, "i8")
        gain[kind & 1 > 0] = some
        tail[kind & 2 > 0] = np.rint(np.log10(product.astype("f8")) * 2.0**32)
        tail[kind & 4 > 0] = exact.view("i8")
        task = np.cumsum(part) << Sums.PART
        return task + np.cumsum(at) * tasks + (bucket - task) % tasks, gain, n_tail, tail


def total(sums: DataFrame, tasks: int) -> DataFrame:
    """One row for each row: row, gain, n_tail, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for bucket, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row, *whole = Sums.unpacked(bucket, n, data)
                found.append((row, *(x.astype("f8") for x in whole)))  # below 2 ** 53: exact
                size += n
                if size > WAIT:
                    found = [summed(found)]
                    size = 0
        if found:
            row, gain, n_tail, tail = summed(found)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(gain / 2.0**32), pa.array(n_tail.astype("i8")), pa.array(tail / 2.0**32)], ["row", "gain", "n_tail", "tail"])

    return map_arrow(sums.repartition(tasks, "bucket"), run, "row long, gain double, n_tail long, tail double")


_SUMS = "bucket int, n int, sums binary"


class Packed(NamedTuple):
    """Rows of ``scored`` and ``packed_words``, and the words that their places have by number."""

    rows: DataFrame
    common: np.ndarray


def met(packed: Packed, tasks: int) -> DataFrame:
    """The rows of ``scored``, and of ``Sums``: what met in a task, summed by row."""
    shared = packed.rows.sparkSession.sparkContext.broadcast(packed.common)
    names, last = [*_NAMES[5:], "bucket", "n", "sums"], [pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, found, size = None, ([], [], []), [], 0

        def settle() -> int:
            """Of a group, which is over."""
            whole = [[np.concatenate(x) for x in zip(*g, strict=True)] if g else [np.zeros(0, t) for t in ("i8", "u8", "u8", "i8")] for g in group]
            before = len(found)
            if group[PLACES]:
                row, gain = gains(*whole[PLACES])
                found.append((row, gain, np.zeros(len(row)), np.zeros(len(row))))
            if group[RARE]:
                (who, key, word, times), (_, known, n, _) = whole[RARE], whole[VOCABULARY]
                row, n_tail, tail = rare(who, key, word.astype("i8") * times, known, n.astype("f8"))
                found.append((row, np.zeros(len(row)), n_tail, tail))
            for g in group:
                g.clear()
            return sum(len(x[0]) for x in found[before:])

        def out() -> pa.RecordBatch:
            """Of what is summed: one part."""
            rows = list(zip(*Sums.packed(tasks, *found[0]), strict=True))
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(rows[0]), t) for t in _TYPES[5:]], *[pa.array(x, t) for x, t in zip(rows, last, strict=True)]], names)

        for batch in batches:
            own = batch.filter(pc.is_null(batch["packed"])).select(_NAMES[5:])
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.nulls(own.num_rows, t) for t in last]], names)
            few = (batch.select(_NAMES[:5]).slice(a, 64) for a in range(0, batch.num_rows, 64))
            for at, kind, first, places, data in (x for part in few for x in zip(*[c.to_pylist() for c in part.columns], strict=True)):
                if data is None:
                    continue
                if at != now and any(group):
                    size += settle()
                    if size > WAIT // 2:
                        found[:] = [summed(found)]
                        size = len(found[0][0])
                        if size > WAIT // 4:
                            yield out()
                            found.clear()
                            size = 0
                now = at
                group[kind].append(Pack.unpacked(first, places, data, shared.value if kind == PLACES else NONE))
        if any(group):
            settle()
        if found:
            found[:] = [summed(found)]
            if len(found[0][0]):
                yield out()

    return map_arrow(packed.rows.repartition(tasks, "part").sortWithinPartitions("part"), run, f"{_SCORED}, {_SUMS}")


def score_texts(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows that aren't held out; by default those with crc32(doc_id) mod 7 = 2 are. Null and empty texts
    are one end token. Repeated rows count, and are scored, as often as they occur; a null id's crc32 is that
    of the empty text. With nothing to learn from, the root's uniform distribution scores. An empty table gives an
    empty result. Texts are read whole, a megabyte at a time; other columns are ignored.
    """
    held = crc_mod(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    spark = docs.sparkSession
    known = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    learn = known.where(~F.col("held_out")).select("text")
    counted = written(first_counts(learn).groupBy("kind", "key").agg(F.sum("n").alias("n")), "first-counts")
    got = counted.where("kind = 1").select("key", "n").toArrow()  # at most 65536 rows
    pairs = np.zeros(65536, "i8")
    pairs[got["key"].to_numpy()] = got["n"].to_numpy()
    vocab = counted.where("kind = 0").select("key", "n")
    named = counted.where("kind = 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    common = named["key"].to_numpy().astype("u4")
    model = train(learn, vocab, pairs.reshape(256, 256))
    n, v, _, _ = model[1]
    tidy(spark)  # counting is over: its shuffles can go
    bits, tasks = max(LEAST_BITS, (n // GROUP).bit_length()), max(2 * spark.sparkContext.defaultParallelism, n // TASK + 1)
    done = written(met(Packed(scored(known, model, bits, common).unionByName(packed_words(vocab, bits)), common), tasks), "scored")
    discard(counted)
    base, sums = done.where("sums IS NULL").drop("bucket", "n", "sums"), total(done.where("sums IS NOT NULL").select("bucket", "n", "sums"), tasks)
    tidy(spark)  # the places have met
    zero = lambda x: F.coalesce(x, F.lit(0))
    return base.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + zero("n_tail")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head") + zero("tail") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + zero("gain")).alias("score"),
    )


def op7_lm_scoring(spark, sf_dir):
    """Every document, learnt from those outside the held-out seventh."""
    return score_texts(table(spark, sf_dir, "documents"))
