"""The composed grammar against its transducers run one after the other, and awkward tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from citegraph.llm import toxicity as tx

SCHEMA = T.StructType([T.StructField(c, k) for c, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("score", T.StringType()), ("toxic", T.StringType()), ("part", T.DoubleType()))])


def paths(symbols, g):
    """Weight of a clause by running every transducer over the whole clause before the next."""
    plain = [(k, tx.NO_MARK) for k in tx.CLASSES]
    tape = [((tx.ARMED if k == tx.THREAT and w > 0 else k), tx.NO_MARK) for k, w in symbols]
    every = [(k, m) for k in tx.CLASSES for m in (tx.NO_MARK, frozenset({tx.NEG}), frozenset({tx.REP}), frozenset({tx.NEG, tx.REP}))]
    final = ()
    for machine in (tx.negation(plain), tx.reported(every), tx.aim(every)):
        state, written = machine.start, []
        for label in tape:
            state, out = machine.arcs[state, label]
            written.append(out)
        tape, final = written, final + machine.final[state]
    factor = lambda marks: (g.negated if tx.NEG in marks else 1) * (g.reported if tx.REP in marks else 1)
    return sum(w * factor(m) for (_, w), (_, m) in zip(symbols, tape)) + sum(getattr(g, name) * factor(m) for name, m in final)


def test_composition_equals_the_cascade():
    rng = random.Random(1)
    g = tx.Grammar(negated=0.3, reported=0.6, target=1.1, threat=2.7)
    for _ in range(3000):
        kinds = [rng.choice([tx.PLAIN, tx.PLAIN, tx.INSULT, tx.THREAT, tx.TARGET, tx.NEGATOR, tx.REPORT, tx.QUOTE]) for _ in range(rng.randrange(0, 12))]
        symbols = [(k, round(rng.uniform(1, 5), 2) if k == tx.INSULT or (k == tx.THREAT and rng.random() < 0.5) else 0.0) for k in kinds]
        assert tx.run_clause(symbols, g)[0] == pytest.approx(paths(symbols, g))


def test_arcs_are_complete():
    machine = tx.AUTOMATON
    states = {s for s, _ in machine.arcs}
    assert states == set(machine.final) and len(states) > 50
    assert len(machine.arcs) == len(states) * len(tx.CLASSES)


def test_quotes_close_and_verbs_have_forms():
    g = tx.Grammar(words={"scum": 4.0}, reported=0.25)
    best = lambda text: tx.Matcher(g).features(pa.array([text]))[0, 0]
    assert best('"scum" it is') == pytest.approx(1.0)
    assert best('the "word" scum') == pytest.approx(4.0)
    assert best('one "open scum') == pytest.approx(1.0)
    for verb in ("killing", "kills", "stabbed", "tötet", "verletzen", "tuera", "mataré", "heriré"):
        assert verb in tx.THREATS
        assert best(f"{verb} you now") == pytest.approx(g.threat), verb
    assert best("killing time") == 0 and best("never kill you") == pytest.approx(g.threat * g.negated)


def test_odd_tables(spark):
    """Nulls, repeats, one doc_id in very many rows, clashing names, long texts, no labels."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() for _ in range(30)) + (" you idiot" if bad else ""), "x", "y", 0.5))
        marks.append((i, int(bad)))
    rows += [(3, rows[3][1], None, None, None)] * 500 + [(None, "you idiot", None, None, None), (900, None, "", "", 0.0), (901, "", "", "", 0.0), (902, "fine " * 600_000 + "you idiot", "", "", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks + [(None, 1), (901, None)], "doc_id long, toxic int")
    out = tx.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert by[902] == 1 and by[900] == by[901] == 0 and by[None] == 1
    assert sum(by[i] == int(i % 4 == 0) for i in range(400)) == 400
    assert all(r["score"] == 0 for r in tx.score(docs, labels.limit(0)).collect())
    assert tx.score(docs.limit(0), labels).count() == 0
