"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; every document of the
training fold is unlabelled web text. The model is additive over text
statistics: each statistic is cut at its quantiles over the unlabelled text
and every bin has a weight.

1. A logistic model of positive against unlabelled gives a ranking.
2. The class prior is the smallest ratio, over score thresholds, between the
   share of unlabelled and of positive rows above the threshold, with an
   allowance for sampling error (best-bin estimate).
3. The final weights minimise the non-negative unbiased risk
   prior * R_p+ + max(0, R_u- - prior * R_p-) with logistic losses. Each step
   is a damped Newton step on sums over all rows; where the negative part
   falls below zero the step climbs out of it instead.

All sums run over every row of the training fold in one Spark job a step;
partial sums are added in tasks, so that the driver gets 16 rows of fixed
width, whatever the input.

Edge cases: null and empty texts have no words and get a score like any
other; without positives or unlabelled rows all scores are 0.5; a null doc_id
is not held out and has no label; a doc_id labelled both ways is a positive;
repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm.quality_rules import FEATURES, measure
from citegraph.llm.store import write_once
from citegraph.llm.textscan import Texts, chunks

BINS = 12
STEPS = 12
RIDGE = 1e-3
#: step of the climb while the negative part of the risk is below zero
CLIMB = 0.5
THRESHOLD = 0.3
_PARTS = 16


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the doc_id as text, modulo ``k``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(k))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                got = measure(Texts(part.column("text")))
                x = np.column_stack([got[f].astype(np.float64) for f in FEATURES])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _design(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """0/1 design matrix: one bin of each statistic, and a constant."""
    width = sum(len(c) + 1 for c in cuts) + 1
    out = np.zeros((len(x), width), np.float32)
    out[:, -1] = 1
    at = 0
    for j, c in enumerate(cuts):
        out[np.arange(len(x)), at + np.searchsorted(c, x[:, j], "left")] = 1
        at += len(c) + 1
    return out


def _rows(batch) -> np.ndarray:
    col = batch.column("x")
    return col.flatten().to_numpy().reshape(len(col), len(FEATURES))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(train: DataFrame, cuts, w: np.ndarray) -> list[tuple]:
    """For unlabelled and positive rows: (n, loss as negatives, sum p x, sum x, sum p (1 - p) x x')."""
    d = len(w)

    def run(batches):
        tot = np.zeros((2, 2 + 2 * d + d * d))
        for batch in batches:
            pos = batch.column("positive").to_numpy(zero_copy_only=False)
            x = _design(_rows(batch), cuts).astype(np.float64)
            z = x @ w
            p = _sigmoid(z)
            loss = np.logaddexp(0, z)
            for k, at in ((0, slice(None)), (1, pos)):
                xs, ps = x[at], p[at]
                tot[k] += np.concatenate(([len(xs), loss[at].sum()], ps @ xs, xs.sum(0), ((xs * (ps * (1 - ps))[:, None]).T @ xs).ravel()))
        part = TaskContext.get().partitionId() % _PARTS
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tot.ravel()], pa.list_(pa.float64()))], names=["part", "s"])

    def add(batch):
        s = np.array(batch.column("s").to_pylist()).sum(0)
        return pa.table({"part": batch.column("part")[:1], "s": pa.array([s], pa.list_(pa.float64()))})

    got = train.select("x", "positive").mapInArrow(run, "part int, s array<double>").groupBy("part").applyInArrow(add, "part int, s array<double>").collect()
    tot = sum((np.array(r["s"]) for r in got), np.zeros(2 * (2 + 2 * d + d * d))).reshape(2, -1)
    return [(r[0], r[1], r[2 : 2 + d], r[2 + d : 2 + 2 * d], r[2 + 2 * d :].reshape(d, d)) for r in tot]


def _newton(train, cuts, gradient) -> np.ndarray:
    """gradient(sums, w) gives (gradient, curvature) without the ridge, which is added here."""
    w = np.zeros(sum(len(c) + 1 for c in cuts) + 1)
    for _ in range(STEPS):
        sums = _sums(train, cuts, w)
        if not sums[0][0] or not sums[1][0]:
            return w
        g, h = gradient(sums)
        step = np.linalg.solve(h + RIDGE * np.eye(len(w)), g + RIDGE * w)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return w


def _against_unlabelled(sums):
    (nu, _, pu, _, hu), (np_, _, pp, xp, hp) = sums
    return pu / nu + (pp - xp) / np_, hu / nu + hp / np_


def _nn_risk(prior, sums):
    (nu, lu, pu, _, hu), (np_, lp, pp, xp, hp) = sums
    if lu / nu - prior * lp / np_ < 0:
        return -CLIMB * (pu / nu - prior * pp / np_), hu / nu + prior * hp / np_
    # with logistic losses R_p+ - R_p- is linear in the scores
    return pu / nu - prior * xp / np_, hu / nu


def _scored(cuts, w, columns: list[str]):
    def run(batches):
        for batch in batches:
            p = _sigmoid(_design(_rows(batch), cuts) @ w)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(p, pa.float64())], names=[*columns, "score"])

    return run


def class_prior(train: DataFrame, cuts, w: np.ndarray, bins: int = 500) -> float:
    """Best-bin estimate of the share of positives among the unlabelled rows."""
    s = train.select("x", "positive").mapInArrow(_scored(cuts, w, ["positive"]), "positive boolean, score double")
    rows = s.groupBy(F.floor(F.col("score") * bins).alias("b")).agg(F.count(F.lit(1)).alias("u"), F.sum(F.col("positive").cast("int")).alias("p")).collect()
    u, p = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in rows:
        u[r["b"]], p[r["b"]] = r["u"], r["p"]
    nu, np_ = u.sum(), p.sum()
    above_u, above_p = np.cumsum(u[::-1]) / nu, np.cumsum(p[::-1]) / np_
    slack = np.sqrt(np.log(40) / (2 * nu)) + np.sqrt(np.log(40) / (2 * np_))
    ok = above_p > 0
    i = int(np.argmin((above_u[ok] + slack) / above_p[ok]))
    return float(np.clip(above_u[ok][i] / above_p[ok][i], 0.01, 0.99))


def train_model(train: DataFrame) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(cuts, weights, prior) from rows (x, positive)."""
    at = [F.col("x")[j] for j in range(len(FEATURES))]
    probs = [k / BINS for k in range(1, BINS)]
    got = train.select(*[F.percentile_approx(c, probs, 2000).alias(f"q{j}") for j, c in enumerate(at)]).first()
    cuts = [np.unique(np.array(q or [], float)) for q in got]
    first = _newton(train, cuts, _against_unlabelled)
    if not np.any(first):
        return cuts, first, 0.5
    prior = class_prior(train, cuts, first)
    return cuts, _newton(train, cuts, partial(_nn_risk, prior)), prior


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of the held-out fold are never read."""
    x = write_once(features(docs), "quality-features").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)))
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_d")).distinct().withColumn("positive", F.lit(True))
    rows = x.filter(~F.col("held_out")).join(good, F.col("doc_id") == F.col("_d"), "left")
    train = write_once(rows.select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "quality-training")
    cuts, w, _ = train_model(train)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = x.mapInArrow(_scored(cuts, w, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
