"""Toxicity by a weighted finite-state pattern grammar.

Words are runs of ASCII letters, apostrophes and non-ASCII characters (A-Z
folded); clauses end at . ! ? ; and newlines. Transducers over a clause:

- the lexicon maps a word to a class and a weight: insults and their weights
  (lower confidence bound of the log ratio of their document rates in toxic and
  clean training texts; whole words, or prefixes where a prefix says as much),
  threat verbs in their forms (``THREATS``, with a weight where they are
  learned too), targets, negators, reporting verbs, quotation marks;
- ``negation`` counts ``SCOPE`` words down from a negator and marks the hits in
  its scope;
- ``reported`` marks hits after a reporting verb up to the clause's end, and
  hits between quotation marks;
- ``aim`` remembers a personal target, a weighted hit and the least marked
  threat; its final states carry the target's bonus (hit and target) and the
  threat's bonus (threat and target).

Each is a table of arcs (state, input label) -> (state, output label), a label
being a class with its marks. ``compose`` builds the automaton of all three
from the tables; a hit's weight is multiplied by the factor of each mark on
its arc, final bonuses by those of the threat. Only clauses with a hit are
run. A document's score is a logistic function of its best and its summed
clause weights.

Lexicon weights come from three quarters of the labelled sample (part 0); the
factors of negation and reported speech, bonuses and logistic weights from the
rest. The sample has at most ``MAX_LABELLED`` labelled rows, by a hash of doc_id.

Edge cases: null and empty texts match nothing and get the score of no match;
without labels of both kinds every score is 0; a null doc_id is not held out
and has no label; a doc_id labelled both ways is toxic; repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.pu_quality import fold
from citegraph.llm.store import ascii_lower, write_once
from citegraph.llm.textscan import Texts, chunks

#: labelled documents that the grammar is learned from, at most
MAX_LABELLED = 30_000
#: an entry is in this many toxic documents of its part; the lower bound of its log ratio, DEVIATIONS below
#: the estimate, is MIN_WEIGHT at least (one toxic document in ten: six toxic and no clean ones do, in any sample)
MIN_TOXIC, DEVIATIONS = 4, 1.64
MIN_WEIGHT = 2.3
PREFIXES = (4, 5, 6)
SCOPE = 3
THRESHOLD = 0.3

#: closed word classes of the four languages, plain text
NEGATORS = "not no never don't isn't aren't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTING = "said says wrote called claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
TARGETS = "you your you're u he she they them du dich dein ihr sie tu toi vous votre ils elles tú usted ustedes ellos".split()
#: stems of threat verbs of each language, and the endings that their forms have
THREAT_STEMS = (
    ("kill hurt destroy burn shoot stab", "- s ed ing er ers"),
    ("töt verletz", "en e st t et est te tet ten test end"),
    ("tu bless", "er e ons ez ent é ée és erai eras era erons erez eront ait"),
    ("mat her", "ar ir o as an é ó aré iré ará irá arás irás aremos arán irán ando ado ido"),
)
THREATS = [stem + ending.strip("-") for stems, endings in THREAT_STEMS for stem in stems.split() for ending in endings.split()] + "shot stabbed stabbing shooting hiero hiere hieren hirió".split()

_WORD = np.zeros(256, bool)
_WORD[[39, *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 59, 63]] = True
WORD_PATTERN = r"[A-Za-z'\x{80}-\x{10FFFF}]+"

#: classes of words; a threat verb with a learned weight is ARMED
PLAIN, INSULT, THREAT, TARGET, NEGATOR, REPORT, QUOTE, ARMED = range(8)
CLASSES = range(8)
HITS = (INSULT, THREAT, ARMED)


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    negated: float = 0.5
    reported: float = 0.5
    target: float = 0.5
    #: of a threat with a target; until enough are seen, that of the weakest lexicon entry
    threat: float = MIN_WEIGHT
    #: weights of (1, best clause, log of summed clauses); None: nothing learned
    logistic: tuple[float, float, float] | None = None


#: what a clause's hits are: neither damped, negated, reported; and a threat composed with a target
CLEAR, NEGATED, REPORTED, THREATENED = 1, 2, 4, 8


#: what a hit was marked with
NO_MARK, NEG, REP = frozenset(), "negated", "reported"


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs (state, label) -> (state, label) from ``start``; ``final``: bonuses (name, marks) of end states."""

    start: object
    arcs: dict
    final: dict


def _table(start, labels, step, final=lambda state: ()) -> Transducer:
    """The arcs that can be reached, from a step function over states and labels."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for label in labels:
            arcs[state, label] = step(state, label)
            if arcs[state, label][0] not in seen:
                seen.add(arcs[state, label][0])
                todo.append(arcs[state, label][0])
    return Transducer(start, arcs, {s: final(s) for s in seen})


def _marked(label, mark, on: bool):
    kind, marks = label
    return (kind, marks | {mark}) if on and kind in HITS else label


def negation(labels) -> Transducer:
    """States 0 .. SCOPE: words that are left in a negator's scope."""
    return _table(0, labels, lambda left, label: (SCOPE if label[0] == NEGATOR else max(0, left - 1), _marked(label, NEG, left > 0)))


def reported(labels) -> Transducer:
    """States (after a reporting verb, between quotation marks)."""

    def step(state, label):
        verb, quoted = state
        return (verb or label[0] == REPORT, quoted != (label[0] == QUOTE)), _marked(label, REP, verb or quoted)

    return _table((False, False), labels, step)


def aim(labels) -> Transducer:
    """States (target seen, weighted hit seen, marks of the least marked threat)."""

    def step(state, label):
        target, hit, threat = state
        kind, marks = label
        if kind in (THREAT, ARMED) and (threat is None or len(marks) < len(threat)):
            threat = marks
        return (target or kind == TARGET, hit or kind in (INSULT, ARMED), threat), label

    def final(state):
        target, hit, threat = state
        return ((("target", NO_MARK),) if target and hit else ()) + ((("threat", threat),) if target and threat is not None else ())

    return _table((False, False, None), labels, step, final)


def compose(first: Transducer, second: Transducer, labels) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``."""

    def step(state, label):
        one, written = first.arcs[state[0], label]
        two, out = second.arcs[state[1], written]
        return (one, two), out

    return _table((first.start, second.start), labels, step, lambda state: first.final[state[0]] + second.final[state[1]])


def grammar_automaton() -> Transducer:
    """negation, reported and aim over the plain classes, as one table."""
    plain = [(k, NO_MARK) for k in CLASSES]
    after = [*plain, *[(k, frozenset({NEG})) for k in HITS]]
    every = [*after, *[(k, m) for k in HITS for m in (frozenset({REP}), frozenset({NEG, REP}))]]
    return compose(compose(negation(plain), reported(after), plain), aim(every), plain)


AUTOMATON = grammar_automaton()


def run_clause(symbols: list[tuple[int, float]], g: Grammar) -> tuple[float, int]:
    """Weight of a clause under the composed transducers; flags of the hits that it holds."""
    state, total, flags, arcs = AUTOMATON.start, 0.0, 0, AUTOMATON.arcs
    factor = lambda marks: (g.negated if NEG in marks else 1.0) * (g.reported if REP in marks else 1.0)
    seen = lambda marks: (NEGATED if NEG in marks else 0) | (REPORTED if REP in marks else 0) or CLEAR
    for kind, weight in symbols:
        state, (_, marks) = arcs[state, (ARMED if kind == THREAT and weight > 0 else kind, NO_MARK)]
        if weight > 0:
            total += weight * factor(marks)
            flags |= seen(marks)
    for bonus, marks in AUTOMATON.final[state]:
        total += getattr(g, bonus) * factor(marks)
        if bonus == "threat":
            flags |= seen(marks) | THREATENED
    return total, flags


class Matcher:
    """Finds the clauses of many texts that hold a lexicon entry, and runs the grammar on them."""

    def __init__(self, g: Grammar):
        self.g = g
        self.closed = {w: k for k, ws in ((TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORT, REPORTING)) for w in ws}
        self.words = self._table({w.encode(): v for w, v in g.words.items()})
        self.prefixes = {}
        for p, v in g.prefixes.items():
            self.prefixes.setdefault(len(p.encode()), {})[p.encode()] = v
        self.prefixes = {n: self._table(t) for n, t in sorted(self.prefixes.items())}
        self.threats = self._table({w.encode(): 1.0 for w in THREATS})

    @staticmethod
    def _table(entries: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        if not entries:
            return np.zeros(0, np.uint64), np.zeros(0)
        t = Texts(pa.array([e.decode() for e in entries]))
        h = t.hashes(t.off[:-1], t.off[1:])
        order = np.argsort(h)
        return h[order], np.array(list(entries.values()))[order]

    @staticmethod
    def _look(table, h: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], 0.0)

    def clauses(self, column: pa.Array):
        """(text number, symbols) of every clause with a hit."""
        t = Texts(column, lower=True)
        start, end, doc = t.runs(_WORD[t.data])
        weight = self._look(self.words, t.hashes(start, end))
        for n, table in self.prefixes.items():
            long = np.flatnonzero(end - start >= n)
            weight[long] = np.maximum(weight[long], self._look(table, t.hashes(start[long], start[long] + n)))
        threat = self._look(self.threats, t.hashes(start, end)) > 0
        hits = np.flatnonzero((weight > 0) | threat)
        if not len(hits):
            return t.n, []
        ends = np.concatenate(([0], np.cumsum(_END[t.data])))[start]
        out, seen = [], -1
        for i in hits.tolist():
            if i <= seen:
                continue
            lo = hi = i
            while lo and doc[lo - 1] == doc[i] and ends[lo - 1] == ends[i]:
                lo -= 1
            while hi + 1 < len(doc) and doc[hi + 1] == doc[i] and ends[hi + 1] == ends[i]:
                hi += 1
            symbols, before = [], end[lo - 1] if lo and doc[lo - 1] == doc[i] else t.off[doc[i]]
            cuts = np.flatnonzero(_END[t.data[before : start[lo]]])
            before += int(cuts[-1]) + 1 if len(cuts) else 0  # marks before the clause's first word
            for j in range(lo, hi + 1):
                symbols += [(QUOTE, 0.0)] * int((t.data[before : start[j]] == 34).sum())
                before = end[j]
                if threat[j] or weight[j] > 0:
                    symbols.append((THREAT if threat[j] else INSULT, float(weight[j])))
                else:
                    word = t.data[start[j] : end[j]].tobytes().decode("utf-8", "replace") if end[j] - start[j] <= 16 else ""
                    symbols.append((self.closed.get(word, PLAIN), 0.0))
            out.append((int(doc[i]), symbols))
            seen = hi
        return t.n, out

    def features(self, column: pa.Array) -> np.ndarray:
        """(best clause, log(1 + sum), flags of all hits, target beside a lexicon entry, lexicon entry) of each text."""
        n, found = self.clauses(column)
        out = np.zeros((n, 5))
        for d, symbols in found:
            total, flags = run_clause(symbols, self.g)
            out[d, 0] = max(out[d, 0], total)
            out[d, 1] += total
            out[d, 2] = int(out[d, 2]) | flags
            entry = any(w > 0 for _, w in symbols)
            out[d, 3] = max(out[d, 3], float(entry and any(k == TARGET for k, _ in symbols)))
            out[d, 4] = max(out[d, 4], float(entry))
        out[:, 1] = np.log1p(out[:, 1])
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if self.g.logistic is None:
            return np.zeros(len(column))
        x = self.features(column)
        b, best, more = self.g.logistic
        return 1 / (1 + np.exp(-np.clip(b + best * x[:, 0] + more * x[:, 1], -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """(text, toxic, part) of at most MAX_LABELLED labelled documents outside the held-out fold."""
    y = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), folds) != held)
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # the rows are chosen by doc_id and text hash, so that a doc_id in very many rows fills no task with texts
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    keys = keyed.select("doc_id", "_h").join(F.broadcast(y), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(MAX_LABELLED)
    rows = keyed.join(F.broadcast(keys), ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h"])  # MAX_LABELLED rows of 20 bytes
    return rows.select("text", "toxic", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0).cast("int").alias("part"))


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(words, prefixes) with their weights, from labelled texts."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD_PATTERN), 0))).alias("w"))
    per = words.groupBy("w").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("t"), F.sum((F.col("toxic") != 1).cast("int")).alias("c"))
    n_t, n_c = (rows.agg(F.sum((F.col("toxic") == 1).cast("int")), F.sum((F.col("toxic") != 1).cast("int"))).first()) or (0, 0)
    if not n_t or not n_c:
        return {}, {}
    keys = F.array(F.struct(F.lit(0).alias("len"), F.col("w").alias("term")), *[F.struct(F.lit(n).alias("len"), F.substring("w", 1, n).alias("term")) for n in PREFIXES])
    terms = per.select(F.explode(keys).alias("k"), "t", "c").filter("k.len = 0 OR length(k.term) = k.len")
    ratio = F.log((F.col("t") + 0.5) / (n_t + 1)) - F.log((F.col("c") + 0.5) / (n_c + 1))
    bound = ratio - DEVIATIONS * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    top = (
        terms.groupBy("k.len", "k.term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("v", bound)
        .filter((F.col("t") >= MIN_TOXIC) & (F.col("v") >= MIN_WEIGHT)).collect()
    )  # as many as MAX_LABELLED texts have words in MIN_TOXIC of them
    prefixes, words_ = {}, {}
    for r in sorted(top, key=lambda r: (r["len"] == 0, r["len"], r["term"])):
        shorter = max((prefixes[r["term"][:n]] for n in PREFIXES if (r["len"] == 0 or n < r["len"]) and r["term"][:n] in prefixes), default=0)
        if shorter < r["v"] - 0.7:
            (prefixes if r["len"] else words_)[r["term"]] = float(r["v"])
    return words_, prefixes


def calibrate(g: Grammar, x: np.ndarray, y: np.ndarray) -> None:
    """Damping factors and bonuses from the features of labelled texts."""
    if not len(y) or y.min() == y.max():
        return

    def odds(mask):
        return np.log((y[mask].sum() + 0.5) / ((1 - y[mask]).sum() + 0.5))

    flags, entry = x[:, 2].astype(int), x[:, 4] == 1
    none, plain = flags == 0, flags & CLEAR > 0
    for name, flag in (("negated", NEGATED), ("reported", REPORTED)):
        damped = flags & ~THREATENED == flag
        if damped.sum() >= 20 and plain.sum() >= 20:
            share = (odds(damped) - odds(none)) / max(1e-9, odds(plain) - odds(none))
            setattr(g, name, float(np.clip(share, 0.05, 1.0)))
    aimed = entry & (x[:, 3] == 1)
    if aimed.sum() >= 20 and (entry & ~aimed).sum() >= 20:
        g.target = float(np.clip(odds(aimed) - odds(entry & ~aimed), 0.0, 3.0))
    threatened = ~entry & plain & (flags & THREATENED > 0)
    if threatened.sum() >= 20:
        g.threat = float(np.clip(odds(threatened) - odds(none), 0.0, 10.0))


def fit_logistic(g: Grammar, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic weights on (best, log sum) of labelled texts."""
    if not len(y) or y.min() == y.max():
        return
    d = np.column_stack([np.ones(len(y)), x[:, 0], x[:, 1]])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(3), d.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    g.logistic = tuple(map(float, w))


def learn(rows: DataFrame) -> Grammar:
    rows = write_once(rows, "toxicity-sample")  # read four times
    g = Grammar(*lexicon(rows.filter("part = 0")))
    rest = rows.filter("part = 1").select("text", F.col("toxic").cast("int").alias("toxic"))
    names = [f"x{k}" for k in range(5)]

    def run(batches):
        m = Matcher(g)
        for batch in batches:
            for part in chunks(batch):
                x = m.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *[pa.array(x[:, k]) for k in range(5)]], names=["toxic", *names])

    for fit in (calibrate, fit_logistic):  # the logistic weights see the fitted factors
        # at most MAX_LABELLED rows of six numbers
        got = rest.mapInArrow(run, "toxic int, " + ", ".join(f"{c} double" for c in names)).toPandas()
        fit(g, got[names].to_numpy(float), (got["toxic"] == 1).to_numpy(float))
    return g


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of the held-out fold are never read."""
    g = learn(sample(docs, labels, folds, held))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = Matcher(g)
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.score(part.column("text")))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
