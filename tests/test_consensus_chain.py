"""The registered consensus queries run the reference's whole procedure."""

import numpy as np
import pytest

from citegraph.operators import consensus as K
from citegraph.plans import consensus_queries as CQ


def test_the_chain_has_the_parameters_of_the_reference():
    # runConsensus.m: 1000 centroids, 1000 permutations, p = 0.5, [2:2:15 20:5:50 60:10:200]
    ks = [*range(2, 16, 2), *range(20, 51, 5), *range(60, 201, 10)]
    assert (CQ.N_CENTROIDS, CQ.PERMS, CQ.P_ITEM, CQ.KS) == (1000, 1000, 0.5, ks)


def test_affinity_takes_every_permutation(spark, monkeypatch):
    rows = [(p, i, [float(i % 2), 1.0 + p % 3, float(i)]) for p in range(70) for i in range(4)]
    sv = spark.createDataFrame(rows, "perm int, id int, vec array<double>")
    monkeypatch.setattr(CQ, "_sv", lambda spark, d: sv)
    monkeypatch.setattr(CQ, "KS", [2])
    monkeypatch.setattr(CQ, "PERMS", 70)
    got = CQ.consensus_cluster_affinity(spark, "rows of this test").collect()
    assert {r["perm"] for r in got} == set(range(70)) and len(got) == 280
    share = CQ.exemplar_frequency(spark, "rows of this test").agg({"share": "sum"}).first()[0]
    assert share == pytest.approx(2, abs=1e-4)


def _one_by_one(v, apart, first, metric):
    """One run as the operator is defined: assign, move, until the assignment repeats."""
    centres, at, before = v[first], np.array(first), None
    while True:
        d = K.distances_to(v, centres, metric) if apart is None else apart[:, at]
        near = d.argmin(1)
        if before is not None and (near == before).all():
            return float(d[np.arange(len(v)), near].sum()), near
        before = near
        for c in np.unique(near):
            mine = np.flatnonzero(near == c)
            if apart is None:
                centres[c] = v[mine].mean(0)
            else:
                at[c] = mine[apart[np.ix_(mine, mine)].sum(1).argmin()]


@pytest.mark.parametrize("algo,metric", [("kmeans", "cosine"), ("kmeans", "euclidean"), ("pam", "correlation")])
def test_runs_that_advance_together_equal_single_ones(monkeypatch, algo, metric):
    monkeypatch.setattr(K, "STEP_VALUES", 3000)  # a few runs at a time
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(60, 5)), np.zeros((2, 5))])
    v = np.concatenate([v, v[:6]])  # equal items
    apart = K.distances_to(v, v, metric) if algo == "pam" else None
    for k in (1, 7, 40):
        firsts = [rng.permutation(len(v))[:k] for _ in range(9)]
        got = K._settled_runs(v, apart, firsts, metric, 1000)
        want = [_one_by_one(v, apart, f, metric) for f in firsts]
        assert len(got) == 9 and all((a[1] == b[1]).all() and a[0] == pytest.approx(b[0]) for a, b in zip(got, want))


def test_communities_within_tasks_equal_those_of_jobs(spark, monkeypatch):
    from citegraph.operators import communities as CO

    rng = np.random.default_rng(8)
    rows = [(g, int(a), int(b), round(float(rng.uniform(0, 1 + 4 * (a % 3 == b % 3))), 3)) for g, n in ((0, 30), (1, 17)) for a in range(n) for b in range(a, n) if rng.random() < 0.5]
    rows += [(2, 0, 1, 0.0), (2, 2, 3, 1.0), (2, 4, 4, 1.0), (0, 5, 3, 0.25)]
    edges = spark.createDataFrame(rows, "perm int, i int, j int, w double")
    jobs = sorted(map(tuple, CO.modularity_communities(edges, "perm", task_nodes=0).collect()))
    monkeypatch.setattr(CO, "_settled_in_jobs", None)  # before: every round was some jobs
    assert sorted(map(tuple, CO.modularity_communities(edges, "perm").collect())) == jobs
    assert len({c for p, _, c in jobs if p == 0}) > 1


@pytest.mark.parametrize("metric", K.METRICS)
def test_pair_distances_equal_the_distance_of_two_vectors(spark, metric):
    rng = np.random.default_rng(9)
    rows = [(i, r.tolist()) for i, r in enumerate(rng.normal(size=(40, 6)))] + [(40, [0.0] * 6), (41, [2.0] * 6), (42, None), (43, [1.0, None, 0.0, 1.0, 2.0, 3.0]), (44, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id int, vec array<double>")
    got = {(r["i"], r["j"]): r["dist"] for r in K.pair_distance(v, metric).collect()}
    a, b = (v.select(v.id.alias(c), v.vec.alias(f"{c}v")) for c in "ij")
    want = {(r["i"], r["j"]): r["d"] for r in a.join(b.hint("merge"), a.i < b.j).select("i", "j", K.distance("iv", "jv", metric).alias("d")).collect()}
    odd = lambda pair: 44 in pair  # a vector of another length has no distance to speak of
    assert got.keys() == want.keys() and all(got[p] == want[p] for p in want if not odd(p))


def test_blocks_of_pairs_grow_with_the_table():
    # before: 256 rows whatever the table, so 360,000 items were copied 1,407 times
    assert -(-360_000 // K._rows_per_block(360_000, 6)) == 60
    assert all(16 <= K._rows_per_block(n, 6) <= K.BLOCK_ROWS for n in (0, 1, 500, 10**7))
    assert -(-500 // K._rows_per_block(500, 6)) >= 6  # few items still are some tasks'
