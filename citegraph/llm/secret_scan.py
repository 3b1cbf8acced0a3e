"""Secret scan over a trigram inverted index (DataFrame functions only).

1. Every rule's regular expression is turned into a Boolean query over
   trigrams: an OR of ANDs of trigrams that any match must contain
   (``trigram_query``). A rule with an alternative that has no mandatory
   trigram gets no query.
2. ``build_index`` makes the postings (trigram, doc_id) of the trigrams that
   some query names, ASCII letters folded, in one pass over the texts.
3. ``candidates`` intersects the postings: they meet per document, which
   keeps a trigram that is in a third of all documents spread over all tasks.
4. ``scan`` verifies: each rule's expression runs on its candidates only;
   rules without a query run on every text.

Edge cases: a null or empty text has no spans; a null doc_id is a value like
any other; repeated rows give repeated result rows; input columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as sre  # the standard library's own regex parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract, in its order. {24,} finds the same runs as + and a
#: length test, as a run shorter than 24 can never hold a longer one.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Publicly documented credential shapes beyond the base.
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

#: More alternatives than this close the literal run instead of multiplying.
MAX_ALTERNATIVES = 64
#: Classes of up to this many characters are expanded into alternatives.
MAX_CLASS = 8


def _class_chars(items) -> list[str] | None:
    out: list[str] = []
    for op, arg in items:
        if op is sre.LITERAL:
            out.append(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out.extend(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _runs(parsed, alts: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
    """Extend alternatives (closed literal runs, open run) by a parsed sequence."""

    def close(xs):
        return list(dict.fromkeys(((*done, run), "") for done, run in xs))

    for op, arg in parsed:
        before = alts
        if op is sre.LITERAL:
            alts = [(done, run + chr(arg)) for done, run in alts]
        elif op is sre.IN and (chars := _class_chars(arg)):
            alts = [(done, run + c) for done, run in alts for c in chars]
        elif op is sre.SUBPATTERN:
            alts = _runs(arg[3], alts)
        elif op is sre.BRANCH:
            alts = [x for branch in arg[1] for x in _runs(branch, alts)]
        elif op is sre.MAX_REPEAT:
            lo, hi, sub = arg
            if (lo, hi) == (0, 1) and len(sub) == 1 and sub[0][0] is sre.LITERAL:
                alts = alts + _runs(sub, alts)
            elif lo == 0:
                alts = close(alts)
            else:
                once = _runs(sub, alts)
                alts = once if lo == hi == 1 else close(once)
        elif op is not sre.AT:
            alts = close(alts)
        if len(alts) > MAX_ALTERNATIVES:
            alts = close(before)
    return alts


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of trigrams (ASCII lower case); None: no mandatory trigram."""
    query = []
    for done, run in _runs(sre.parse(pattern), [((), "")]):
        grams = frozenset(r[i : i + 3].lower() for r in (*done, run) for i in range(len(r) - 2))
        if not grams:
            return None
        query.append(grams)
    return [q for q in dict.fromkeys(query) if not any(p < q for p in query)]


def _trigram_regex(grams: list[str]) -> str:
    """A lookahead that captures each of ``grams`` wherever it starts, factored by first letter."""
    by: dict[str, list[str]] = {}
    for g in grams:
        by.setdefault(g[0], []).append(g[1:])
    body = "|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, rest))})" for a, rest in sorted(by.items()))
    return f"(?i)(?=({body}))"


def build_index(docs: DataFrame, rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """Postings (trigram, doc_id) of all trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for q in trigram_query(r.pattern) or [] for g in q})
    found = F.regexp_extract_all("text", F.lit(_trigram_regex(grams)), 1)
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.array_distinct(found), F.lower))).alias("trigram"))


def candidates(index: DataFrame, rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, mask): bit r is set where rule r's Boolean query holds."""
    terms, alt = [], 0
    for r, rule in enumerate(rules):
        for q in trigram_query(rule.pattern) or []:
            for i, g in enumerate(sorted(q)):
                terms.append(F.struct(F.lit(g).alias("trigram"), F.lit(1 << r).alias("rule"), F.lit(alt).alias("alt"), F.lit(1 << i).cast("long").alias("bit"), F.lit((1 << len(q)) - 1).cast("long").alias("full")))
            alt += 1
    # a table of the rules' own size, a few hundred rows, whatever the input
    table = index.sparkSession.range(1).select(F.inline(F.array(*terms)))
    met = index.join(F.broadcast(table), "trigram").groupBy("doc_id", "alt", "rule", "full").agg(F.bit_or("bit").alias("bits"))
    return met.filter("bits = full").groupBy("doc_id").agg(F.bit_or("rule").alias("mask"))


def _spans(text: Column, rule: Rule, k: int) -> Column:
    """array<struct<start,k,end>> of a rule's matches in code points, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, 0)
    groups = hits if rule.group == 0 else F.regexp_extract_all(text, pattern, rule.group)
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"))),
        groups,
        lambda s, g: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), (F.length(g) >= rule.least).alias("ok")),
    )
    span = "struct<start:bigint,k:int,end:bigint>"

    def add(acc, s):
        start = acc["at"] + s["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(k).alias("k"), (start + s["len"]).alias("end")))
        return F.struct((start + s["len"]).alias("at"), F.when(s["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    return F.aggregate(steps, zero, add, lambda acc: acc["out"])


def scan(docs: DataFrame, rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, text, found): all rules' spans of each row, by start and then rule."""
    docs = docs.select("doc_id", "text")
    cand = candidates(build_index(docs, rules), rules).withColumnRenamed("doc_id", "_id")
    df = docs.join(cand, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    parts = []
    for r, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            ask = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0
        else:
            ask = F.regexp_like("text", F.lit(rule.pattern))
        parts.append(F.when(ask, _spans(F.col("text"), rule, r)).otherwise(none))
    return df.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("found"))


def listed(spans: Column, rules=BASE_RULES + MORE_RULES) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, sha256 of the base spans, all spans."""
    rules = BASE_RULES + MORE_RULES
    count = lambda k: F.size(F.filter("found", lambda s: s["k"] == k)).cast("long")
    return scan(docs, rules).select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(listed(F.filter("found", lambda s: s["k"] < len(BASE_RULES)), rules), 256).alias("base_sha256"),
        listed(F.col("found"), rules).alias("spans"),
    )
