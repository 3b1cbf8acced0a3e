"""Phrase mining: the FM-index against plain counts, the whole job against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.llm import oracles
from citegraph.llm import phrase_mining as pm

SCHEMA = T.StructType([T.StructField(c, k) for c, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("h1", T.StringType()), ("n", T.StringType()), ("a", T.DoubleType()), ("phrase", T.IntegerType()))])


def brute(rows, least=pm.LEAST, keep=pm.KEEP):
    counts, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        low = (r[1] or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:keep])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "to", "new", "york", "New", "City", "é", "ß", "naïve", "文", "x1", "#", "(a", "b)", "\xa0", "'", '"', "a-b"]
    out = [None, "", " \t ", ".,;", "word", "new york city " * 40, "new york. city, " * 15, "tie a tie b tie a tie b " * 10, "x\ny\rz\x0bq\x0cw " * 12, "Ä ä " * 11, "one line\tand tabs\t\tin it " * 12]
    for _ in range(150):
        text = []
        for _ in range(rng.randrange(1, 60)):
            w = rng.choices(words, weights=[30, 10, 20, 20, *[4] * 16])[0]
            text.append("new york city" if w == "new" and rng.random() < 0.7 else w)
            if rng.random() < 0.15:
                text.append(rng.choice([".", ",", "\n", "!", "?", ";", ":", "\t", "  "]))
        out.append(" ".join(text))
    docs = [(i, t, [None, "en", "de", "und", "x y"][i % 5 if i % 3 else 1], None, "h", None, 0.5, i) for i, t in enumerate(out)]
    return docs + [(None, "null id new york " * 6, "en", None, None, None, None, None), docs[7], docs[7], docs[9]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_fm_index_extends_both_ways():
    rng = np.random.default_rng(1)
    for size, kinds in ((1, 1), (60, 3), (3000, 12), (3000, 400)):
        symbols = rng.integers(0, kinds + 1, size).astype(np.uint32)
        symbols[-1] = 0
        index = pm.FMIndex.of(symbols, kinds)
        allowed = np.ones(kinds + 1, bool)
        allowed[0] = False
        s = symbols.tolist()
        plain = {k: Counter(tuple(s[i : i + k]) for i in range(len(s) - k + 1) if 0 not in s[i : i + k]) for k in (1, 2, 3)}
        told = lambda p: {tuple(w): n for w, n in zip(p.words.tolist(), p.width.tolist()) if n}
        one = index.words()
        assert told(one) == plain[1]
        left, right = index.left(one, allowed), index.right(one, allowed)
        assert told(left) == told(right) == plain[2]
        place = lambda p: {tuple(w): (f, b) for w, f, b in zip(p.words.tolist(), p.forward.tolist(), p.backward.tolist())}
        assert place(left) == place(right), "both ways give the same rows of both indexes"
        words, n = index.count_right(left, allowed)
        assert {tuple(w): k for w, k in zip(words.tolist(), n.tolist())} == plain[3] == told(index.left(right, allowed))
        some = allowed.copy()
        some[1::2] = False
        assert told(index.left(one.only(some[1:]), some)) == {p: n for p, n in plain[2].items() if some[list(p)].all()}


@pytest.mark.parametrize("shard", [1, 700, 16 << 20])
def test_whole_job(docs, rows, monkeypatch, shard):
    monkeypatch.setattr(pm, "SHARD_BYTES", shard)
    want = brute(rows)
    assert sorted(tuple(r) for r in pm.digest(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == want
    assert {r[0] for r in want} >= {"en", "und", "de"} and len({r[7] for r in want}) > 10


def test_small_bounds_and_ties(docs, rows):
    got = pm.Phrases(docs, least=2).top(7)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 7)


def test_frequent_phrases(docs, rows):
    p = pm.Phrases(docs, least=5)
    spelled = {(r["lang"], r["h1"]): r["word"] for r in p.words.collect()}
    triples = {(r["lang"], *(spelled[r["lang"], r[f"h{k}"]] for k in (1, 2, 3))): r["n"] for r in p.triples.collect()}
    assert triples["en", "new", "york", "city"] > 40 and all(n >= 5 for n in triples.values())


def test_empty_tables(spark):
    assert pm.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pm.digest(spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, " . ", "en", None, None, None, None, None)], SCHEMA)).count() == 0


def test_score_is_exact(spark):
    a, left, right = 999_999_999_999_937, 999_999_999_999_989, 999_999_999_999_947
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (10, 2**40, 2**40), (7, 11, 13)], "a long, l long, r long")
    got = [r[0] for r in df.select(pm.score("a", "l", "r").alias("s"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]
    assert got == [1_000_000 * x * x // (y * z) for x, y, z in ((a, left, right), (10, 10, 10), (10, 2**40, 2**40), (7, 11, 13))]


def test_long_text(spark):
    """One text longer than a work chunk and than a shard."""
    rows = [(1, "alpha beta gamma, delta " * 130_000, "en", None, None, None, None, None), (2, "alpha beta " * 20, "en", None, None, None, None, None)]
    assert sorted(tuple(r) for r in pm.digest(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_sql(docs, rows):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toArrow())
    got = con.execute(oracles.phrase_mining()).fetchall()
    assert sorted(tuple(r) for r in got) == brute(rows)
