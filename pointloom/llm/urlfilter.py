"""URL rules as glob patterns, matched all at once by a bit-parallel wildcard automaton.

Every pattern is a run of bits in one long mask, packed into 64-bit words: a start bit, then a bit for each
character. Reading a character moves all patterns of a URL together, as in Shift-And:
``D = ((D << 1) & B[c]) | (D & S)``, where ``B`` says which bits accept the character and ``S`` which stay
under a ``*``. NumPy runs the step for all URLs of an Arrow batch, longest first, so ended URLs drop out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import LOWER, UPPER, map_arrow, table

_AZ = str.maketrans(UPPER, LOWER)
#: Stands between host and path; no character has this code.
BORDER = 0x110000


class HostRule(NamedTuple):
    """Fits a host and its subdomains where the path starts with ``path``. The longest rule that fits wins."""

    host: str
    path: str
    verdict: str


class GlobRule(NamedTuple):
    """``*`` stands for any characters, ``?`` for one; host and path must match whole. Used where no host rule fits."""

    host: str
    path: str
    verdict: str


#: The contract's rules.
HOST_RULES = (HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"), HostRule("net", "/es/", "block"), HostRule("net", "/fr/", "block"))
GLOB_RULES = tuple(GlobRule(f"*{word}*", "*", "block") for word in ("spam", "casino", "cheap-pills", "adult-", "free-bets", "ads-track")) + (GlobRule("*", "*/ads/*", "block"), GlobRule("*", "*.exe", "block"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) by the contract; both empty for null and for urls without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    end = min((i for i in (rest.find(c, at) for c in "?#") if i >= 0), default=len(rest))
    return rest[:at].translate(_AZ), rest[at:end]


ANY, ONE = -1, -2


def _tokens(glob: str) -> list[int]:
    return [ANY if c == "*" else ONE if c == "?" else ord(c) for c in glob]


class Automaton:
    """Many patterns, each a list of codes, ``ANY`` and ``ONE``."""

    def __init__(self, patterns: Sequence[Sequence[int]]):
        bits = sum(1 + sum(c != ANY for c in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        codes = sorted({c for p in patterns for c in p if c >= 0})
        self.codes = np.array(codes, "i8")
        accept = np.zeros((len(codes) + 1, self.words * 64), bool)  # the last row: any other character
        start, stay, self.final, at = np.zeros(self.words * 64, bool), np.zeros(self.words * 64, bool), [], -1
        for p in patterns:
            at += 1
            start[at] = True
            for c in p:
                if c == ANY:
                    stay[at] = True
                    continue
                at += 1
                accept[slice(None) if c == ONE else codes.index(c), at] = True
            self.final.append(at)
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8")
        self.accept, self.start, self.stay = pack(accept), pack(start), pack(stay)

    def matches(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """(texts, patterns) booleans. Each text is an array of codes."""
        sizes = np.fromiter(map(len, texts), "i8", len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([*(texts[i] for i in order), np.zeros(1, "i8")])
        offsets = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
        kind = np.searchsorted(self.codes, flat).clip(max=max(0, len(self.codes) - 1))
        kind = np.where(self.codes[kind] == flat, kind, len(self.codes)) if len(self.codes) else np.zeros(len(flat), "i8")
        state = np.repeat(self.start[None], len(texts), 0)
        active = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="right")
        for step, n in enumerate(active):
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.accept[kind[offsets[:n] + step]]) | (d & self.stay)
        out = np.zeros((len(texts), len(self.final)), bool)
        final = np.array(self.final, "i8")
        if len(final):
            out[order] = (state[:, final // 64] >> (final % 64).astype("u8")) & np.uint64(1)
        return out


def filter_urls(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, glob_rules: Sequence[GlobRule] = GLOB_RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, glob, verdict.

    ``rule`` is the longest host rule that fits, else null; ``glob`` the first glob rule that matches (null where
    a host rule fits); no rule at all means allow. Null urls and urls without ``://`` have an empty host and
    path. Repeated rows are judged alike; an empty table gives an empty result; other columns, which aren't read, don't matter.
    """
    host_rules, glob_rules = tuple(host_rules), tuple(glob_rules)
    patterns = [[ANY, *_tokens("."), *map(ord, r.host), BORDER, *map(ord, r.path), ANY] for r in host_rules]
    patterns += [[ord("."), *_tokens(r.host), BORDER, *_tokens(r.path)] for r in glob_rules]
    longest = sorted(range(len(host_rules)), key=lambda i: -len(host_rules[i].host + host_rules[i].path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        names = [r.host + r.path for r in host_rules]
        for batch in batches:
            parts = [split_url(u.as_py()) for u in batch.column(1)]
            codes = [np.concatenate([np.frombuffer(("." + h).encode("utf-32-le"), "<u4"), [BORDER], np.frombuffer(p.encode("utf-32-le"), "<u4")]).astype("i8") for h, p in parts]
            rules, globs, verdicts = [], [], []
            for row in automaton.matches(codes):
                i = next((i for i in longest if row[i]), None)
                j = next((j for j in range(len(glob_rules)) if row[len(host_rules) + j]), None) if i is None else None
                rules.append(None if i is None else names[i])
                globs.append(None if j is None else glob_rules[j].host + " " + glob_rules[j].path)
                verdicts.append(host_rules[i].verdict if i is not None else glob_rules[j].verdict if j is not None else "allow")
            texts = [pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rules, globs, verdicts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *texts], ["page_id", "host", "path", "rule", "glob", "verdict"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), run, "page_id long, host string, path string, rule string, glob string, verdict string")


def op5_url_filters(spark, sf_dir):
    """Every page's url."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_AFTER = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_AFTER}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
_FITS = "('.' || host) LIKE '%.{}' AND path LIKE '{}%'"
OP5_SQL = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h.host, h.path)} THEN '{h.host}{h.path}'" for h in sorted(HOST_RULES, key=lambda h: -len(h.host + h.path)))} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  {" ".join(f"WHEN rule = '{h.host}{h.path}' THEN '{h.verdict}'" for h in HOST_RULES)}
  {" ".join(f"WHEN host LIKE '{g.host.replace('*', '%')}' AND path LIKE '{g.path.replace('*', '%')}' THEN '{g.verdict}'" for g in GLOB_RULES)}
  ELSE 'allow' END AS verdict FROM r
"""
