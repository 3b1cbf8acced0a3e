"""Modularity, spectral clustering, block pairs, co-association by bits, spherical k-means, path sources."""

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import graph_oracles as GO
from citegraph.operators import centrality as CE
from citegraph.operators import communities as CO
from citegraph.operators import consensus as K


def planted(rng, nodes, groups, inside, outside):
    return [(a, b, 1.0) for a, b in combinations(range(nodes), 2) if rng.random() < (inside if a % groups == b % groups else outside)]


def partition_quality(edges, label):
    m2 = 2 * sum(w for *_, w in edges)
    inside, strength = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        strength[label[a]] += w
        strength[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / m2 - (strength[c] / m2) ** 2 for c in strength)


def test_modularity_finds_planted_groups(spark):
    rng = random.Random(4)
    graphs = {0: planted(rng, 24, 3, 0.9, 0.03), 1: [*planted(rng, 20, 2, 0.9, 0.03), (0, 0, 2.0)], 2: [(0, 1, 0.0), (2, 3, 1.0)]}
    rows = [(g, b, a, w) if (a + b) % 2 else (g, a, b, w) for g, e in graphs.items() for a, b, w in e]
    history = []
    out = CO.modularity_communities(spark.createDataFrame(rows, "perm int, i int, j int, w double"), "perm", history=history).collect()
    label = defaultdict(dict)
    for r in out:
        label[r["perm"]][r["node"]] = r["community"]
    assert label[0] == {n: n % 3 for n in range(24)} and label[1] == {n: n % 2 for n in range(20)}
    assert label[2] == {0: 0, 1: 1, 2: 2, 3: 2}
    for g, e in graphs.items():
        steps = [h[(g,)] for h in history]
        assert all(y >= x - 1e-12 for x, y in zip(steps, steps[1:])), "modularity never falls"
        assert steps[-1] == pytest.approx(partition_quality(e, label[g]))


def test_modularity_of_one_graph_and_of_none(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "x", 0.2), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0)], "i string, j string, w double")
    got = {r["node"]: r["community"] for r in CO.modularity_communities(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert CO.modularity_communities(edges.limit(0)).count() == 0


def rings(rng):
    out = []
    for ring, radius, n in ((0, 1.0, 14), (1, 6.0, 30)):
        for t in range(n):
            a = 2 * math.pi * t / n
            out.append((ring * 100 + t, [radius * math.cos(a) + rng.gauss(0, 0.02), radius * math.sin(a) + rng.gauss(0, 0.02)]))
    return out


def test_spectral_separates_two_rings(spark):
    sv = spark.createDataFrame([(0, i, v) for i, v in rings(random.Random(3))], "perm int, id int, vec array<double>")
    got = K.consensus_cluster(sv, [2, 999], "spectral", "euclidean").collect()
    assert {r["k"] for r in got} == {2} and len(got) == 44
    assert len({r["cluster"] for r in got if r["id"] < 100}) == 1 and len({(r["id"] >= 100, r["cluster"]) for r in got}) == 2
    with pytest.raises(ValueError):
        K.consensus_cluster(sv, [2], "spectral", "unknown")


def test_affinity_is_scaled_by_neighbours(spark):
    d = {(1, 2): 1.0, (1, 3): 4.0, (2, 3): 2.0, (4, 5): 0.0}
    dist = spark.createDataFrame([(0, i, j, x) for (i, j), x in d.items()], "perm int, i int, j int, dist double")
    got = {(r["i"], r["j"]): r["w"] for r in K.scaled_affinity(dist, 1).collect()}
    assert got[1, 2] == pytest.approx(math.exp(-1 / (1 * 1))) and got[1, 3] == pytest.approx(math.exp(-16 / (1 * 2))) and got[4, 5] == 1.0


def test_modularity_clusters_of_subsamples(spark):
    rng = random.Random(6)
    rows = [(p, i, [float(i % 3 == c) * 5 + rng.gauss(0, 0.1) for c in range(3)]) for p in (0, 1) for i in range(12) if (i + p) % 4]
    got = K.consensus_cluster(spark.createDataFrame(rows, "perm int, id int, vec array<double>"), [], "modularity", "correlation").collect()
    assert {r["k"] for r in got} == {3} and len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["perm"], r["cluster"]].add(r["id"] % 3)
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_block_pairs_are_all_pairs_once(spark, block):
    v = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0]) for i in range(11)], "id int, vec array<double>")
    got = K.pair_distance(v, "euclidean", rows_per_block=block).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted(combinations(range(11), 2))
    assert all(r["dist"] == pytest.approx(math.dist([r["i"], r["i"] ** 2 % 7], [r["j"], r["j"] ** 2 % 7])) for r in got)
    plan = K.pair_distance(v, list(K.METRICS), rows_per_block=block)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_coassociation_counts(spark):
    rng = random.Random(5)
    perms, ids, ks = 70, range(9), [2, 5]
    held = {(p, i) for p in range(perms) for i in ids if i != 8 and rng.random() < 0.5} | {(3, 8)}
    held = {x for x in held if x not in {(p, 7) for p in range(perms)} or x[0] == 69}
    label = {(p, k, i): rng.randrange(k) for p, i in held for k in ks}
    labels = spark.createDataFrame([(p, k, i, c) for (p, k, i), c in label.items()], "perm int, k int, id int, cluster int")
    sampled = spark.createDataFrame(sorted(held), "perm int, id int")
    got = {(r["k"], r["i"], r["j"]): r["consensus"] for r in K.coassociation_matrix(labels, sampled, ks, rows_per_block=4).collect()}
    want = {}
    for k in ks:
        for i, j in combinations(sorted({i for _, i in held}), 2):
            both = [p for p in range(perms) if (p, i) in held and (p, j) in held]
            want[k, i, j] = sum(label[p, k, i] == label[p, k, j] for p in both) / len(both) if both else None
    assert got.keys() == want.keys() and any(v is None for v in want.values())
    assert all(got[x] is None if v is None else got[x] == pytest.approx(v) for x, v in want.items())


def test_kmeans_cost_is_not_above_a_single_fit(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(7)
    points = [(i, (rng.normal(size=6) + 4 * np.eye(6)[i % 6]).tolist()) for i in range(240)]
    v = spark.createDataFrame(points, "id int, vec array<double>")
    assign, cents = K.kmeans_cosine(v, 9, restarts=20, seed=3)
    label = {r["id"]: r["cluster"] for r in assign.collect()}
    unit = {i: np.array(p) / np.linalg.norm(p) for i, p in points}
    total = 0.0
    for c in set(label.values()):
        members = [unit[i] for i in label if label[i] == c]
        centre = np.sum(members, axis=0)
        total += sum(1 - m @ centre / np.linalg.norm(centre) for m in members)
    x = v.select(array_to_vector(F.col("vec")).alias("features"))
    single = KMeans(k=9, distanceMeasure="cosine", maxIter=1000, seed=3).fit(x).summary.trainingCost
    assert len(label) == 240 and cents.count() == len(set(label.values()))
    assert total <= single + 1e-9


def test_paths_from_some_sources_and_inverse_weights(spark):
    rng = random.Random(11)
    edges = [(f"n{a}", f"n{b}", round(rng.uniform(0.5, 4), 2)) for a, b in combinations(range(40), 2) if rng.random() < 0.15]
    simple = spark.createDataFrame([(1, min(u, v), max(u, v), w) for u, v, w in edges], "year int, u string, v string, w double")
    back = [(u, v, 1 / w) for u, v, w in edges]
    got = {r["node"]: r["closeness"] for r in CE.closeness_centrality(simple, inverse=True, in_flight=1).collect()}
    want = GO.closeness(back)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)
    some = spark.createDataFrame([(1, "n3"), (1, "n5"), (1, "gone")], "year int, node string")
    got = {r["node"]: r["closeness"] for r in CE.closeness_centrality(simple, sources=some).collect()}
    want = GO.closeness(edges)
    assert got == pytest.approx({n: want[n] for n in ("n3", "n5")})
    every = {r["node"]: r["betweenness"] for r in CE.betweenness_centrality(simple, sources=10_000).collect()}
    want = GO.betweenness(edges)
    assert all(every[n] == pytest.approx(want[n]) for n in want)
    part = CE.betweenness_centrality(simple, sources=12)
    assert part.count() == len(want) and all(r["betweenness"] >= 0 for r in part.collect())


def test_eigenvector_rounds_do_not_move_the_arcs(spark):
    simple = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 2.0)], "year int, u string, v string, w double")
    arcs = CE._bucketed(CE._arcs(simple, ["year"], False), ["year", "src"])
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0)], "year int, src string, x double")
    plan = arcs.join(x.hint("merge"), ["year", "src"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan


def test_kmeans_round_sends_sums_of_changed_clusters_only(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 4))
    v = np.concatenate([v, v[:5], v[:5]])  # equal points count as often as they are there
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = spark.createDataFrame([(row.tolist(),) for row in v], "vec array<double>")
    blocks = K._blocks(x, 4)
    centres = v[:14].reshape(2, 7, 4).copy()
    told = np.full((2, 7, 3), -1)
    rows = K._lloyd_round(blocks, centres, told)
    assert sorted(r["restart"] for r in rows) == [0, 1]
    for r in rows:
        near = (v @ centres[r["restart"]].T).argmax(1)
        seen = np.frombuffer(r["seen"], np.int64).reshape(7, 3)
        assert seen[:, 0].tolist() == np.bincount(near, minlength=7).tolist()
        sums = np.frombuffer(r["sums"]).reshape(-1, 4)
        assert np.allclose(sums, [v[near == c].sum(0) for c in range(7)])
        told[r["restart"]] = seen
    # told the same, nothing is sent; a centre that moves sends the clusters that gain or lose points
    again = K._lloyd_round(blocks, centres, told)
    assert all(len(r["sums"]) == 0 for r in again)
    centres[1, 0] = -centres[1, 0]
    for r in K._lloyd_round(blocks, centres, told):
        seen = np.frombuffer(r["seen"], np.int64).reshape(7, 3)
        changed = (seen != told[r["restart"]]).any(1) & (seen[:, 0] > 0)
        near = (v @ centres[r["restart"]].T).argmax(1)
        want = [v[near == c].sum(0) for c in np.flatnonzero(changed)]
        assert changed.any() == (r["restart"] == 1)
        assert np.allclose(np.frombuffer(r["sums"]).reshape(-1, 4), np.array(want).reshape(-1, 4))
