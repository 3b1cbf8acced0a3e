"""Learned operators held against plain definitions: risk and gradient, decision lists, labels of a chain."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.llm import language_crf, pu_quality, quality_rules


# ------------------------------------------------------------------ 3


def plain_risk(x, positive, cuts, w, prior):
    """(prior * R_p+, R_u- - prior * R_p-) with logistic losses, row by row."""

    def score(row):
        z, at = w[-1], 0
        for value, c in zip(row, cuts):
            z += w[at + sum(value > t for t in c)]
            at += len(c) + 1
        return z

    z = [score(r) for r in x]
    as_positive = [math.log1p(math.exp(-v)) for v, p in zip(z, positive) if p]
    as_negative = [math.log1p(math.exp(v)) for v, p in zip(z, positive) if p]
    unlabelled = [math.log1p(math.exp(v)) for v in z]
    mean = lambda v: sum(v) / len(v)
    return prior * mean(as_positive), mean(unlabelled) - prior * mean(as_negative)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    positive = rng.random(90) < 0.4
    x = rng.normal(size=(90, len(pu_quality.FEATURES))) + positive[:, None] * 0.7
    cuts = [np.array([-0.5, 0.6])] * 2 + [np.array([])] * (len(pu_quality.FEATURES) - 2)
    df = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive)], "x array<double>, positive boolean").repartition(3)
    return x, positive, cuts, df


@pytest.mark.parametrize("prior,climbs", [(0.3, False), (0.99, True)])
def test_gradient_of_the_risk(train, prior, climbs):
    """Every derivative by differences of the plain risk; below zero the step climbs out of the negative part."""
    x, positive, cuts, df = train
    w = np.random.default_rng(1).normal(0, 0.3, sum(len(c) + 1 for c in cuts) + 1)
    if climbs:  # positives far above the unlabelled rows
        w[[0, 1, 2, 3, 4, 5]] = [-3, 0, 3, -3, 0, 3]
    negative = plain_risk(x, positive, cuts, w, prior)[1]
    assert (negative < 0) == climbs
    g, h = pu_quality._nn_risk(prior, pu_quality._sums(df, cuts, w))
    step = 1e-5
    for j in range(len(w)):
        parts = []
        for sign in (1, -1):
            v = w.copy()
            v[j] += sign * step
            good, bad = plain_risk(x, positive, cuts, v, prior)
            parts.append(-pu_quality.CLIMB * bad if climbs else good + bad)
        assert g[j] == pytest.approx((parts[0] - parts[1]) / (2 * step), abs=1e-6)
    assert np.allclose(h, h.T) and np.linalg.eigvalsh(h).min() > -1e-9


def test_weights_minimise_the_risk(train):
    x, positive, cuts, df = train
    prior = 0.3
    w = pu_quality._newton(df, cuts, lambda s: pu_quality._nn_risk(prior, s))

    def risk(v):
        good, bad = plain_risk(x, positive, cuts, v, prior)
        return good + max(0.0, bad) + pu_quality.RIDGE / 2 * float(v @ v)

    at = risk(w)
    assert at < risk(np.zeros_like(w)) - 0.01
    rng = np.random.default_rng(2)
    assert all(risk(w + rng.normal(0, 0.05, len(w))) > at - 1e-6 for _ in range(60))


# ------------------------------------------------------------------ 5


def plain_gain(x, bad, inside, feature, above, value):
    held = [i for i in inside if (x[feature][i] > value) == above]
    p, p0 = sum(bad[i] for i in held), sum(bad[i] for i in inside)
    return p * (math.log2(p / len(held)) - math.log2(p0 / len(inside))) if p else 0.0


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    x = {f: np.round(rng.random(2000), 2) for f in quality_rules.FEATURES}
    a, b = quality_rules.FEATURES[3], quality_rules.FEATURES[5]
    bad = ((x[a] > 0.7) & (x[b] <= 0.6)) | (x[b] > 0.9)
    return x, bad, rng.random(2000) < 0.67


def test_condition_is_the_best_of_all(table):
    x, bad, grow = table
    got = quality_rules._best_condition(x, bad, grow)
    inside = np.flatnonzero(grow).tolist()
    best = 0.0
    for f in quality_rules.FEATURES:
        values = sorted({float(x[f][i]) for i in inside})
        for low, high in zip(values, values[1:]):
            best = max(best, *(plain_gain(x, bad, inside, f, above, (low + high) / 2) for above in (True, False)))
    assert plain_gain(x, bad, inside, got.feature, got.above, got.value) == pytest.approx(best)


def test_list_covers_in_order(table):
    """Each rule is grown on what those before it left, and right on the pruning rows it rejects."""
    x, bad, grow = table
    rules = quality_rules.learn(x, bad, grow)
    assert rules
    left = set(range(len(bad)))
    for rule in rules:
        assert 1 <= len(rule) <= quality_rules.MAX_CONDITIONS
        first = quality_rules._best_condition(x, bad, np.array([i in left and bool(grow[i]) for i in range(len(bad))]))
        assert rule[0] == first
        hit = {i for i in left if all((x[c.feature][i] > c.value) == c.above for c in rule)}
        prune = [i for i in hit if not grow[i]]
        assert prune and sum(bad[i] for i in prune) >= quality_rules.PRECISION * len(prune)
        left -= hit
    assert sum(bad[i] for i in left) < 0.1 * sum(bad)


def test_verdict_equals_the_list(spark, table):
    x, bad, grow = table
    rules = quality_rules.learn(x, bad, grow)
    kinds = T.StructType([T.StructField(f, T.DoubleType()) for f in dict.fromkeys([*quality_rules.FEATURES, "n_words", "n_repeat_words"])])
    rows = []
    for i in range(len(bad)):
        q = {f.name: float(x[f.name][i]) if f.name in x else 0.0 for f in kinds}
        q["n_words"], q["n_repeat_words"] = (30.0 if i % 9 == 0 else 100.0), (60.0 if i % 7 == 0 else 0.0)
        rows.append((i, q))
    df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("_q", kinds)]))
    for i, kept in df.select("i", quality_rules.verdict(rules).alias("kept")).collect():
        q = rows[i][1]
        base = q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"]
        rejected = any(all((q[c.feature] > c.value) == c.above for c in rule) for rule in rules)
        assert kept == (not base and not rejected)


# ------------------------------------------------------------------ 9


def test_label_is_the_sum_of_all_labellings():
    """Shares by adding up every labelling of a text's words; words weigh by their bytes."""
    texts = ["the cat and der hund und the dog", "der kleine hund", "und", "the", "12 the 34 und", "Ärger und the"]
    model = language_crf.fit(["the cat and the dog sat", "a dog and the cat", "der hund und die katze", "die katze und der hund sass"], ["en", "en", "de", "de"])
    names, scores = model.predict(pa.array(texts, pa.string()))
    assert set(model.langs) == {"en", "de"}
    t = language_crf.Texts(pa.array(texts, pa.string()), lower=True)
    start, end, doc = t.runs(language_crf._WORD[t.data])
    kind, feat, first = language_crf.word_types(t, start, end)
    word = model.emissions(feat, first)[kind]
    for d in range(len(texts)):
        at = np.flatnonzero(doc == d)
        total, share = 0.0, np.zeros(2)
        for y in itertools.product(range(2), repeat=len(at)):
            v = model.start[y[0]] + sum(word[i, c] for i, c in zip(at, y)) + sum(model.trans[a, b] for a, b in zip(y, y[1:]))
            total += math.exp(v)
            for i, c in zip(at, y):
                share[c] += math.exp(v) * (end[i] - start[i])
        share /= total * sum(end[i] - start[i] for i in at)
        assert names[d] == model.langs[int(share.argmax())]
        assert scores[d] == pytest.approx(share.max(), abs=1e-6)


def test_no_letters_no_language():
    model = language_crf.fit(["the cat", "der hund"], ["en", "de"])
    texts = [None, "", "12 !! 34", "٠١", "ж"]
    names, scores = model.predict(pa.array(texts, pa.string()))
    assert names[:4] == ["und"] * 4 and scores[:4].tolist() == [0.0] * 4
    assert all((n == "und") == (not re.search(r"[^\W\d_]", x or "")) for n, x in zip(names, texts))
