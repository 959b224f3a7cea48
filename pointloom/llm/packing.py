"""Best-fit packing of token sequences, planned on the histogram of their lengths.

The plan never looks at documents: best-fit decreasing runs on the driver over ``capacity`` counts
(how many pieces have each length) and yields slots: "ranks r0..r1 of length L go to sequences from
s, ``per`` in each, from offset o". Pieces then find their slot by joining on their rank within
their length. The slot table depends on ``capacity`` alone, not on the number of documents.

Ranks are dealt without a global sort: each task numbers its own pieces of each length while
tokenizing, and the counts by (length, task) give each task its first rank.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import map_arrow, table, written

CAPACITY, END = 1024, 2
#: Pieces that a task holds before it gives them on.
FLUSH = 4096
TOKENIZER = "byte_bpe_50k.json"

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them.

    Where the same vocabulary is there as ranks, ``tiktoken`` merges the bytes, several times faster and to
    the same ids. Texts that the two might treat differently go to ``tokenizers``: those with a
    special token's string, with characters whose Unicode class depends on the version, or with a very long blank run.
    """

    PLAIN = r"[\n\r\t\x20-\x7E¡-ɏΑ-Ρα-ωА-я‐-‧€]*"
    BLANK = r"\s{2000}"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain, self.blank = regex.compile(self.PLAIN).fullmatch, regex.compile(self.BLANK).search
        self.fast = self.by_ranks(path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def by_ranks(path: str):
        import public_tokenizers
        import tiktoken

        if not os.path.exists(path):
            return None
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or any(s in text for s in self.special) or not self.plain(text) or self.blank(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, capacity: int, end: int, tokenizer: str, keep_ids: bool) -> DataFrame:
    """One row per piece, with ``task`` and ``nth``: its number among the task's pieces of its length."""

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "nth": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {}) | {"task": pa.int64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(tokenizer_path(tokenizer)), np.array([end], "<u4").tobytes()
        task, seen, rows = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8"), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + stop
                n, doc = len(ids) // 4, doc_id.as_py()
                first = n if n <= capacity else n % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n + 1, capacity)], strict=True)):
                    part = ids[4 * a : 4 * b]
                    kept = (np.frombuffer(part, "<i4"),) if keep_ids else ()
                    rows.append((doc, piece, a, b - a, zlib.crc32(part), int(seen[b - a]), *kept, task))
                    seen[b - a] += 1
                    if len(rows) == FLUSH:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * keep_ids + ", task long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Slots: (length, first rank, end rank, first sequence, per sequence, offset).

    Equal sequences are handled as ranges, so the work depends on the distinct lengths and free
    spaces, not on how many pieces there are. A length whose count is zero gets no slot.
    """
    slots, spaces, free, opened = [], [], {}, 0

    def give(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                give(capacity, opened, n := -(-left // (capacity // length)))
                opened += n
                continue
            space = spaces[at]
            first, n = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
            per = min(space // length, left)
            taken = min(n, left // per)
            slots.append((length, rank, rank + taken * per, first, per, capacity - space))
            rank, left = rank + taken * per, left - taken * per
            give(space - per * length, first, taken)
            give(space, first + taken, n - taken)
    return slots


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``keep_ids``, the
    token ids. Null and empty texts are one piece holding just the end id. Only documents longer than
    ``capacity`` are cut: all pieces are full but the first, which takes the remainder. Repeated rows are
    packed as often as they occur; null ids are kept; an empty table gives an empty result; columns
    other than doc_id and text are ignored. Very long texts become many pieces, never one sequence.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, capacity, end, tokenizer, keep_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = spark.createDataFrame(plan_slots(counts, capacity), "slot_length long, r0 long, r1 long, s0 long, per long, o0 long")
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    nth = F.col("rank") - F.col("r0")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s0") + F.floor(nth / F.col("per"))).alias("sequence_id"),
        (F.col("o0") + nth % F.col("per") * F.col("length")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def op1_best_fit_packing(spark, sf_dir):
    """All documents, 1024 tokens a sequence; the ids themselves are left out, their checksum stays."""
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
