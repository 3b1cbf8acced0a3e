"""Skew-safe code paths against brute force on a fixture with one hot group.

Group "hot" holds a third of all rows; every operator must give exactly the
result of a plain-Python computation over the whole input.
"""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.operators import aggregates as A
from citegraph.operators import windows as Wn
from citegraph.operators.skew import pairs_within_groups


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = [("hot", i, round(rnd.random(), 3)) for i in range(300)]
    for g in range(60):
        for i in range(rnd.randint(1, 10)):
            out.append((f"g{g}", 1000 + g * 20 + i, round(rnd.random(), 3)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g STRING, k INT, v DOUBLE")


def test_salted_pairs_brute_force(df, rows):
    got = pairs_within_groups(df.select("g", "k"), ["g"], "k", ["k"], ["k"], hot_rows=50)
    got = sorted((r.g, r.l_k, r.r_k) for r in got.collect())
    by = defaultdict(list)
    for g, k, _ in rows:
        by[g].append(k)
    exp = sorted((g, a, b) for g, ks in by.items() for a, b in itertools.permutations(ks, 2) if a < b)
    assert got == exp


def test_topk_brute_force(df, rows):
    got = sorted((r.g, r.k, r.rank) for r in Wn.topk_per_group(df, "g", "v", "k", 7, salts=8).collect())
    by = defaultdict(list)
    for g, k, v in rows:
        by[g].append((-v, k))
    exp = sorted((g, k, i + 1) for g, lst in by.items() for i, (_, k) in enumerate(sorted(lst)[:7]))
    assert got == exp


def test_exact_median_brute_force(df, rows):
    got = {r.g: r.median for r in A.exact_median(df, "g", "v").collect()}
    by = defaultdict(list)
    for g, _, v in rows:
        by[g].append(v)
    for g, vals in by.items():
        assert got[g] == pytest.approx(float(np.median(vals)))


def test_ecdf_brute_force(df, rows):
    got = {(r.g, r.v): r.F for r in Wn.ecdf(df, "g", "v").collect()}
    by = defaultdict(list)
    for g, _, v in rows:
        by[g].append(v)
    for g, vals in by.items():
        for v in set(vals):
            assert got[(g, v)] == pytest.approx(sum(x <= v for x in vals) / len(vals))


def test_keep_first_brute_force(df, rows):
    got = {r.g: (r.k, r.v) for r in Wn.keep_first_dedup(df, ["g"], [F.col("v").desc(), "k"]).collect()}
    by = defaultdict(list)
    for g, k, v in rows:
        by[g].append((-v, k))
    for g, lst in by.items():
        negv, k = min(lst)
        assert got[g] == (k, -negv)


def test_median_by_value_ranges(spark, df, rows):
    """Few ranges and a small bound, so that the interval is narrowed several times; ties, one value, null keys and values."""
    import statistics

    by = defaultdict(list)
    for g, _, v in rows:
        by[g].append(v)
    more = [("flat", 2.0)] * 40 + [("two", 1.0)] * 20 + [("two", 5.0)] * 20 + [(None, float(i)) for i in range(51)] + [("gone", None), ("wide", -1e12), ("wide", 1e12), *[("wide", i / 7) for i in range(60)]]
    for g, v in more:
        if v is not None:
            by[g].append(v)
    x = df.select("g", "v").union(spark.createDataFrame(more, "g STRING, v DOUBLE"))
    got = {r["g"]: r["m"] for r in A.exact_median(x, "g", "v", "m", bins=4, small=6).collect()}
    assert got.keys() == by.keys()
    assert all(got[g] == pytest.approx(statistics.median(v)) for g, v in by.items())
    plan = A.exact_median(x, "g", "v", "m")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_search_by_successive_halving(spark):
    from citegraph.operators import scoring as SC

    rnd = random.Random(3)
    rows = []
    for i in range(400):
        a, b = rnd.random(), rnd.random()
        rows.append((i, i % 3, None if i % 9 == 0 else a, b, 3 * a + (b > 0.5) + rnd.gauss(0, 0.05)))
    df = spark.createDataFrame(rows, "id INT, fold INT, a DOUBLE, b DOUBLE, y DOUBLE")
    space = [{**p, "maxIter": 6, "maxDepth": 2 + i % 3} for i, p in enumerate(SC.draw_params(10))]
    model, best, table = SC.hyperparameter_search(df, ["a", "b"], "y", "fold", space, rungs=(1, 3, 50), max_trees=8)
    per = [[r for r in table if r[1] == k] for k in range(3)]
    assert [len(x) for x in per] == [10, 4, 2] and {r[2] for r in per[2]} == {6}
    for earlier, later in zip(per, per[1:]):
        kept = {r[0] for r in later}
        assert max(r[3] for r in earlier if r[0] in kept) <= min(r[3] for r in earlier if r[0] not in kept)
    assert best == space[min(per[2], key=lambda r: (r[3], r[0]))[0]]
    pred = SC.gbt_predict(model, df, ["a", "b"]).select("y", "prediction").collect()
    mean = sum(r["y"] for r in pred) / len(pred)
    assert sum((r["prediction"] - r["y"]) ** 2 for r in pred) < 0.5 * sum((mean - r["y"]) ** 2 for r in pred)


def test_principal_components_against_numpy(spark):
    from citegraph.operators import consensus as K

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 7
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id INT, vec ARRAY<DOUBLE>")
    got = np.array([r["score"] for r in K.pca_project(v, 4).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u * s)[:, :4]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_embeddings_of_texts_without_tokens(spark):
    from citegraph.operators import text as X

    docs = spark.createDataFrame([(1, "one two two " * 300), (2, ""), (3, None), (4, "!!")], "doc_id INT, text STRING")
    got = {r["doc_id"]: r["embedding"] for r in X.embed_texts(docs, "doc_id", "text", dim=16, chunk=100).collect()}
    assert got.keys() == {1, 2, 3, 4} and all(v == [0.0] * 16 for k, v in got.items() if k > 1)
    assert 0 < sum(x * x for x in got[1]) <= 1 + 1e-9

    def model():
        return lambda texts: np.array([[len(str(t).split()), 1.0] for t in texts])

    got = {r["doc_id"]: r["embedding"] for r in X.embed_texts(docs, "doc_id", "text", dim=2, chunk=512, encoder=model).collect()}
    assert got[1] == pytest.approx([450.0, 1.0]) and got[2] == got[3] == got[4] == [0.0, 0.0]


def test_pairs_of_blocks_are_not_broadcast(spark):
    from citegraph.operators.consensus import block_pairs

    d = spark.range(300).selectExpr("id", "id % 3 AS v")
    met = block_pairs(d, "id", 16)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    rows = [(r.i, r.j, r.l_v, r.r_v) for r in met.collect()]
    assert sorted(rows) == [(i, j, i % 3, j % 3) for i in range(300) for j in range(i + 1, 300)]


def test_many_pairs_get_many_partitions(df):
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    args = (df.select("g", "k"), ["g"], "k", ["k"], ["k"])
    for hot in (50, 20_000):
        a, b = pairs_within_groups(*args, hot_rows=hot), pairs_within_groups(*args, hot_rows=hot, pairs_per_task=500)
        assert b.rdd.getNumPartitions() > few
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_wide_shuffles_follow_the_rows_and_end_with_the_block(spark):
    from citegraph.session import wide_shuffles

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(c) for c in names]
    with pytest.raises(RuntimeError), wide_shuffles(spark, 1000, 10):
        assert spark.range(50).selectExpr("id % 7 AS g").groupBy("g").count().rdd.getNumPartitions() == 100
        raise RuntimeError
    assert [spark.conf.get(c) for c in names] == before


def test_total_and_median_write_their_rows_once(spark, monkeypatch):
    import citegraph.session as S

    rows = [("a", float(i * 7 % 100)) for i in range(101)] + [("b", 1.0), ("b", 4.0), (None, 2.0), ("c", None)]
    written, cut = [], S.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(S, "cut_lineage", counted)
    got = {r["k"]: (r["total_impact_score"], r["median_impact_score"]) for r in A.sum_and_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    a = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (sum(a), a[50]), "b": (5.0, 2.5), None: (2.0, 2.0), "c": (None, None)}
    assert sum(n > 50 for n in written) == 1  # before: once for the totals, once for the medians
