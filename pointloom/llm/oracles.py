"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

import math

from pointloom.llm import quality
from pointloom.llm.common import LOWER, UPPER
from pointloom.llm.decontaminate import WINDOW
from pointloom.llm.licenses import BASE, COVER, K_EXACT, NOTICES, K, grams_of
from pointloom.llm.linededup import RUN
from pointloom.llm.urlfilter import OP5_SQL

LETTER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {LETTER_WORDS} AS w FROM documents),
i AS (SELECT item_id, {LETTER_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, k + 1, k + {WINDOW}) AS x FROM (SELECT *, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
places AS (SELECT rid, s, n, list_slice(w, s + 1, s + n) AS x FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item_id FROM places JOIN win USING (x)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)
"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, CAST(i - 1 AS INT) AS i, ls[i] AS line, {BLANK_WORDS.format("ls[i]")} AS w FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT a.rid, a.i, b.i AS j, len(b.w) AS m, sum(len(b.w)) OVER (PARTITION BY a.rid, a.i ORDER BY b.i) AS n FROM l a JOIN l b ON a.rid = b.rid AND b.i >= a.i WHERE len(a.w) > 0),
e AS (SELECT rid, i, min(j) AS j FROM r WHERE n >= {RUN} GROUP BY rid, i UNION SELECT rid, max(i), j FROM r WHERE n >= {RUN} AND m > 0 GROUP BY rid, j),
x AS (SELECT e.rid, e.i, e.j, string_agg(array_to_string(l.w, ' '), chr(10) ORDER BY l.i) AS t FROM e JOIN l ON l.rid = e.rid AND l.i BETWEEN e.i AND e.j AND len(l.w) > 0 GROUP BY e.rid, e.i, e.j),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rid, i) AS nth FROM x),
gone AS (SELECT DISTINCT rid, unnest(range(i, j + 1)) AS i FROM o WHERE nth > 1),
runs AS (SELECT rid, CAST(min(i) AS VARCHAR) || '-' || CAST(max(i) + 1 AS VARCHAR) AS run, min(i) AS s FROM (SELECT rid, i, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS g FROM gone) GROUP BY rid, g),
cut AS (SELECT rid, string_agg(run, ',' ORDER BY s) AS lines_cut FROM runs GROUP BY rid),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON l.rid = gone.rid AND l.i = gone.i GROUP BY l.rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(n.n, 0) AS n_lines_cut, coalesce(lines_cut, '') AS lines_cut
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""

_GRAMS = ", ".join(f"({tid}, '{label}', {str(exact).lower()}, {n}, {band}, {k}, {at}, '{gram}')" for tid, label, exact, n, band, k, at, gram in grams_of(BASE + NOTICES))
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {LETTER_WORDS} AS w FROM documents),
g(tid, label, exact, n, band, k, spot, gram) AS (VALUES {_GRAMS}),
p AS (SELECT rid, k, p, array_to_string(list_slice(w, p + 1, p + k), ' ') AS gram FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (VALUES ({K_EXACT}), ({K})) s(k) WHERE len(w) >= k)),
v AS (SELECT rid, p, tid, label, exact, n, band, k, spot, p - spot AS diagonal FROM p JOIN g USING (k, gram)),
base AS (SELECT rid, label, diagonal AS first FROM v WHERE exact GROUP BY rid, tid, label, n, diagonal HAVING count(*) = n),
seeds AS (SELECT rid, tid, diagonal AS seed FROM v WHERE NOT exact GROUP BY rid, tid, n, band, diagonal HAVING count(*) * (2 * band + 1) >= n * {COVER}),
near AS (SELECT rid, label, count(DISTINCT spot) / CAST(n AS DOUBLE) AS cover FROM v JOIN seeds USING (rid, tid) WHERE NOT exact AND abs(diagonal - seed) <= band GROUP BY rid, tid, label, n, seed HAVING count(DISTINCT spot) >= n * {COVER}),
found AS (SELECT rid, label, 1.0::DOUBLE AS cover, first, true AS exact FROM base UNION ALL SELECT rid, label, cover, NULL, false FROM near),
byrow AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT CASE WHEN exact THEN label END, ',' ORDER BY CASE WHEN exact THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN byrow USING (rid)
"""

_TAIL = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(quality.RISK)!r} + (n - i) * {math.log1p(-quality.RISK)!r})))"
_RATES = " UNION ALL ".join(f"SELECT rid, doc_id, stratum, base_failed, '{rule}' AS rule, CASE WHEN {b} = 0 THEN 0 ELSE (1000 * {a} + {b} - 1) // {b} END AS rate FROM r" for rule, (a, b) in quality.RULES.items())
_LEVEL = quality.DELTA / (len(quality.RULES) * (len(quality.STRATA) + 1))
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {BLANK_WORDS.format("coalesce(text, '')")} AS w, CASE WHEN lang IN ({", ".join(f"'{s}'" for s in quality.STRATA)}) THEN lang ELSE 'other' END AS stratum FROM documents),
win AS (SELECT rid, p, list_slice(w, p + 1, p + 3) AS x FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY rid),
ls AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT d.rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals FROM d JOIN ls USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM m),
rates AS ({_RATES}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT stratum, rule, least(rate, {quality.TOP}) AS cut, count(*) AS n_at FROM rates SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
counted AS (SELECT a.stratum, a.rule, a.cut, sum(b.n_at)::BIGINT AS n, coalesce(sum(b.n_at) FILTER (b.cut > a.cut), 0)::BIGINT AS k FROM held a JOIN held b USING (stratum, rule) GROUP BY a.stratum, a.rule, a.cut),
cuts AS (SELECT stratum, rule, min(cut) AS cut FROM counted WHERE k <= n * {quality.SPARE} AND k < n * {quality.RISK} AND {_TAIL} <= {_LEVEL!r} GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT rid FROM rates JOIN cuts USING (stratum, rule) WHERE rate > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.rid IS NULL AS kept FROM r LEFT JOIN rejected USING (rid)
"""

ORACLE_SQL = {
    "op2_benchmark_decontamination": OP2,
    "op3_line_dedup": OP3,
    "op5_url_filters": OP5_SQL,
    "op6_license_scans": OP6,
    "op9_quality_rules": OP9,
}
