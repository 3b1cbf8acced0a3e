"""Quality rules: a learned decision list over text statistics.

``statistics`` counts words, symbols, repeats and so on of every whole text.
``learn`` grows an ordered list of reject rules from labelled statistics by
sequential covering: each rule is a conjunction of thresholds, grown on two
thirds of the rows by information gain, pruned from its end on the last third,
and kept while it is right often enough there; covered rows leave. The list
becomes one ordered Spark conditional expression (``verdict``).

Edge cases: null and empty texts have no words and fail the base rules; rows
are judged each by itself, repeats alike; labels that are null or name no
document are unused; without labels only the base rules hold; extra columns
pass through ``kept_documents`` and are ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.llm.store import packed, unpacked, write_once
from citegraph.llm.textscan import Texts, chunks, distinct_per_doc, mix, repeated, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "bang_share", "distinct_share", "top_word_share", "words_per_line", "wide_share"]
FEATURES = ["n_words", *RATIOS]

#: labelled rows that the list is learned from, at most, taken by the order of a hash of doc_id
MAX_LABELLED = 30_000
MAX_RULES = 12
MAX_CONDITIONS = 3
#: share of a rule's hits on the pruning rows that must be rejects
PRECISION = 0.95


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars.encode())] = True
    return m


_SYMBOL = _mask("#*$%&|<>")
_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _mask("0123456789")
_PUNCT = _mask("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """Statistics of each text."""
    n, data = texts.n, texts.data
    start, end, doc = texts.words()
    starts_char = (data & 0xC0) != 0x80
    n_words = np.bincount(doc, minlength=n)
    chars = texts.per_doc(starts_char & ~((data == 32) | ((data >= 9) & (data <= 13))))
    h = texts.hashes(start, end)
    tri, at = windows(h, doc, 3)
    twice = at[repeated(mix(tri + doc[at].astype(np.uint64)))]
    in_repeat = np.zeros(len(doc), bool)
    for j in range(3):
        in_repeat[twice + j] = True
    ls, le, ld = texts.lines()
    words_before = np.concatenate(([0], np.cumsum(np.bincount(start, minlength=len(data)) if len(data) else [], dtype=np.int64)))
    full = words_before[le] > words_before[ls]
    # a line that a word reaches into from its start counts too: words never cross a newline, so starts suffice
    ls, le, ld = ls[full], le[full], ld[full]
    n_lines = np.bincount(ld, minlength=n)
    dup_lines = n_lines - distinct_per_doc(texts.hashes(ls, le), ld, n)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(hs)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, ds[first], runs)
    per = lambda a, b: a / np.maximum(1, b)
    symbols, letters = texts.per_doc(_SYMBOL[data]), texts.per_doc(_LETTER[data])
    repeat = np.bincount(doc[in_repeat], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "mean_word": per(chars, n_words),
        "symbols_per_word": per(symbols, n_words),
        "dup_line_share": per(dup_lines, n_lines),
        "repeat_share": per(repeat, n_words),
        "upper_share": per(texts.per_doc(_UPPER[data]), letters),
        "digit_share": per(texts.per_doc(_DIGIT[data]), chars),
        "punct_share": per(texts.per_doc(_PUNCT[data]), chars),
        "bang_share": per(texts.per_doc(data == 33), n_words),
        "distinct_share": per(np.bincount(ds[first], minlength=n), n_words),
        "top_word_share": per(top, n_words),
        "words_per_line": per(n_words, n_lines),
        "wide_share": per(texts.per_doc(data >= 0xC0), chars),
    }


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``_q`` of every text's statistics."""
    own = T.StructType([T.StructField(c, T.LongType() if c in COUNTS else T.DoubleType()) for c in [*COUNTS, *RATIOS]])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_q", own)])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                got = measure(Texts(part.column("_text")))
                q = pa.StructArray.from_arrays([pa.array(got[c], pa.int64() if c in COUNTS else pa.float64()) for c in [*COUNTS, *RATIOS]], names=[*COUNTS, *RATIOS])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], q], names=[*keep, "_q"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x > self.value if self.above else x <= self.value

    def expression(self, q: str) -> Column:
        x = F.col(q)[self.feature]
        return x > self.value if self.above else x <= self.value


def _holds(rule, rows) -> np.ndarray:
    out = np.ones(len(next(iter(rows.values()))), bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _best_condition(rows, bad, inside) -> Condition | None:
    """The threshold with the largest information gain for rejects among the rows ``inside``."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return None
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for f in FEATURES:
        x, y = rows[f][inside], bad[inside]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cut = np.flatnonzero(x[1:] > x[:-1])
        if not len(cut):
            continue
        p, m = np.cumsum(y)[cut], cut + 1
        for above, pp, mm in ((False, p, m), (True, p0 - p, p0 + n0 - m)):
            g = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / mm) - base), 0)
            i = int(np.argmax(g))
            if g[i] > gain:
                gain, best = g[i], Condition(f, above, float((x[cut[i]] + x[cut[i] + 1]) / 2))
    return best


def learn(labelled: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[tuple[Condition, ...]]:
    """Ordered reject rules. labelled: feature columns; grow: rows to grow on, the others prune."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & grow & bad).any():
        rule: list[Condition] = []
        inside = left & grow
        while len(rule) < MAX_CONDITIONS and (c := _best_condition(labelled, bad, inside)):
            rule.append(c)
            inside &= c.holds(labelled)
        if not rule:
            break

        def worth(r):
            hit = _holds(r, labelled) & left & ~grow
            p, m = int((hit & bad).sum()), int(hit.sum())
            return (2 * p - m) / m if m else -1.0

        best = max(range(1, len(rule) + 1), key=lambda k: (round(worth(rule[:k]), 3), -k))
        final = tuple(rule[:best])
        if (worth(final) + 1) / 2 < PRECISION:
            break
        rules.append(final)
        left &= ~_holds(final, labelled)
    return rules


def _labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_y"))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that rules are learned from: those of at most MAX_LABELLED labelled doc_ids, by hash."""
    ids = docs.select("doc_id").join(_labels(labels).select("doc_id"), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")  # MAX_LABELLED ids


def learned_rules(stats: DataFrame, labels: DataFrame) -> list[tuple[Condition, ...]]:
    """Rules from at most MAX_LABELLED labelled rows of ``stats`` (doc_id, _q)."""
    rows = stats.join(_labels(labels), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    got = rows.select("_y", (F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0).alias("_grow"), *[F.col("_q")[f].cast("double").alias(f) for f in FEATURES]).toPandas()
    if not len(got):
        return []
    return learn({f: got[f].to_numpy() for f in FEATURES}, got["_y"].to_numpy() == 0, got["_grow"].to_numpy())


def base_failed(q: str = "_q") -> Column:
    c = F.col(q)
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def verdict(rules: list[tuple[Condition, ...]], q: str = "_q") -> Column:
    """Kept or not: the base rules, then the learned ones in order."""
    out = F.when(base_failed(q), F.lit(False))
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.expression(q)
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def describe(rules) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.value:.6g}" for c in r) for r in rules]


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    rules = learned_rules(write_once(statistics(labelled_documents(docs, labels), ["doc_id"]), "labelled-statistics"), labels)
    return unpacked(statistics(packed(docs), ["_row"], "_row.text").filter(verdict(rules)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = write_once(statistics(docs, ["doc_id"]), "quality-statistics")
    rules = learned_rules(stats, labels)
    return stats.select("doc_id", *[F.col("_q")[c].alias(c) for c in COUNTS], base_failed().alias("base_failed"), verdict(rules).alias("kept"))
