"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

import re

from citegraph.llm.decontaminate import WINDOW
from citegraph.llm.mixing import GOLDEN, LEAST_BLOCK, MODULUS, MOST, MOST_SLOTS, SHARE, SLOTS, SPARE, WEIGHTS
from citegraph.llm.phrase_mining import KEEP, LEAST, OVERLAP
from citegraph.llm.secret_scan import BASE_RULES, MORE_RULES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either_case(pattern: str) -> str:
    """(?i) for ASCII letters outside classes and escapes, spelled out."""
    if not pattern.startswith("(?i)"):
        return pattern
    parts = re.split(r"(\[[^\]]*\]|\\x[0-9A-F]{2})", pattern[4:])
    return "".join(p if k % 2 else re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", p) for k, p in enumerate(parts))


def secret_scan() -> str:
    rules = BASE_RULES + MORE_RULES
    parts = []
    for k, r in enumerate(rules):
        p = "'" + _either_case(r.pattern).replace("'", "''") + "'"
        ok = f"length(g[i]) >= {r.least}"
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'a':
  coalesce(list_sum(list_transform(q[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0),
  'n': length(h[i]), 'ok': {ok}}}), lambda x: x.ok)) AS s FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS h,
  regexp_extract_all(t, {p}, {r.group}) AS g, string_split_regex(t, {p}) AS q FROM d)"""
        )
    spans = " UNION ALL ".join(parts)
    n = len(BASE_RULES)
    one = "kind || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT)"
    counts = ", ".join(f"COUNT(s) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), sp AS ({spans})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY s.a, k) FILTER (WHERE k < {n}), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY s.a, k), '') AS spans
FROM d LEFT JOIN sp USING (doc_id) GROUP BY d.doc_id"""


def decontaminate() -> str:
    words = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH b AS (SELECT item_id, {words} AS w FROM benchmark), bl AS (SELECT item_id, w, LEAST(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM bl)),
d AS (SELECT doc_id, {words} AS w FROM documents),
occ AS (SELECT x.doc_id, x.s, x.n, win.item_id FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n) x
  JOIN win ON win.n = x.n AND win.k = array_to_string(x.w[x.s:x.s + x.n - 1], ' ')),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


def mixing() -> str:
    weights = "[" + ", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS) + "]"
    return f"""WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS n FROM z GROUP BY 1),
w AS (SELECT *, {weights}[(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS wt, {MOST}::DOUBLE * n AS cap FROM s),
l AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cap / wt, source NULLS LAST) AS no,
  ({SHARE}::DOUBLE * (SELECT SUM(n) FROM s) - coalesce(SUM(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / SUM(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
g AS (SELECT source, n, LEAST(wt * coalesce((SELECT arg_min(lv, no) FROM l WHERE lv * wt <= cap), (SELECT arg_max(lv, no) FROM l)), cap) AS target FROM l),
o AS (SELECT z.*, g.n AS source_size, g.target, floor(g.target) AS goal,
  coalesce(SUM(size) OVER (PARTITION BY z.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM z JOIN g ON g.source IS NOT DISTINCT FROM z.source),
h AS (SELECT source, CAST(floor(target) AS BIGINT) AS goal FROM g WHERE floor(target) > 0),
t AS (SELECT CAST(SUM(goal) AS BIGINT) AS total, MIN(goal) AS least, GREATEST({LEAST_BLOCK}, -(-SUM(goal) // {SLOTS})) AS block FROM h),
b AS (SELECT source, floor(SUM(goal) OVER w * ({float(MODULUS)}::DOUBLE / total::DOUBLE)) AS hi,
  floor(coalesce(SUM(goal) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * ({float(MODULUS)}::DOUBLE / total::DOUBLE)) AS lo
  FROM h, t WINDOW w AS (ORDER BY source NULLS LAST)),
i AS (SELECT unnest(range(CAST(ceil(total / block) + LEAST({MOST_SLOTS}, {SPARE} * ceil(total / least)) AS BIGINT))) AS i FROM t),
slot AS (SELECT source, i, ROW_NUMBER() OVER (PARTITION BY source ORDER BY i) - 1 AS r FROM i JOIN b ON i * {GOLDEN} % {MODULUS} >= lo AND i * {GOLDEN} % {MODULUS} < hi),
won AS (SELECT source, COUNT(*) * MIN(block) AS words FROM slot, t GROUP BY 1),
k AS (SELECT o.*, LEAST(goal, coalesce(words, 0)) AS gives, block FROM o LEFT JOIN won ON won.source IS NOT DISTINCT FROM o.source, t),
y AS (SELECT *, CAST(GREATEST(0, LEAST(size, gives - c)) + GREATEST(0, LEAST(size, gives - c - source_size)) AS BIGINT) AS taken FROM k)
SELECT doc_id, size, source_size, target, taken, i AS position
FROM y LEFT JOIN slot ON taken > 0 AND slot.source IS NOT DISTINCT FROM y.source AND slot.r = c // block"""


def phrase_mining() -> str:
    score = "CAST(a AS HUGEINT) * a * 1000000 // (CAST({} AS HUGEINT) * {})".format
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
f AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, COUNT(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k) GROUP BY ALL HAVING COUNT(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, {score('x.a', 'y.a').replace('CAST(a', 'CAST(c.a').replace('* a', '* c.a')} AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, a, array_to_string(w[cut:cut + 1], ' ') AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
r AS (SELECT low.*, ROW_NUMBER() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN inner_ i ON i.lang = low.lang AND i.phrase = low.phrase WHERE k = 3 OR i.longer IS NULL OR 100 * i.longer < {OVERLAP} * a)
SELECT r.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= {KEEP}"""
