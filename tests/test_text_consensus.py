import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.operators import consensus as K
from citegraph.operators import selection as SEL
from citegraph.operators.dip import dip
from citegraph.operators import text as X


def test_tfidf_hand_cases(spark):
    """FIXTURES C.5: word in every cluster (unsmoothed idf 0), one-letter word, accented word."""
    docs = spark.createDataFrame(
        [(1, "a", "Common x café"), (2, "a", "common word"), (3, "b", "common Café other")], "doc_id INT, cluster STRING, text STRING"
    )
    t = X.token_table(docs, "doc_id", "cluster", "text")
    ct = {(r.cluster, r.word): r.tfidf for r in X.class_tfidf(t).collect()}
    assert ct[("a", "common")] == 0.0  # in all clusters
    assert ("a", "café") in ct  # accented word kept whole and lower-cased
    assert ("a", "x") in ct  # one-letter word kept by the unsmoothed statistic
    t2 = X.token_table(docs, "doc_id", "cluster", "text", min_len=2)
    words = {r.word for r in X.cluster_tfidf(t2, docs.select("doc_id", "cluster")).collect()}
    assert "x" not in words and "café" in words
    # smoothed, L2-normalised rows: each cluster vector has unit norm
    norms = X.cluster_tfidf(t2, docs.select("doc_id", "cluster")).groupBy("cluster").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("n"))
    assert all(abs(r.n - 1) < 1e-9 for r in norms.collect())


def test_language_scores(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog"), (2, "le chat et les chiens"), (3, "der Hund und die Katze"), (4, "el perro y los gatos"), (5, "xyz")],
        "doc_id INT, text STRING",
    )
    got = {r.doc_id: r.detected_lang for r in X.language_scores(docs, "text").collect()}
    assert got == {1: "en", 2: "fr", 3: "de", 4: "es", 5: None}


def test_chunks_cover_whole_text(spark):
    df = spark.createDataFrame([(1, list(map(str, range(1100))))], "id INT, tokens ARRAY<STRING>")
    ch = X.chunk_tokens(df, "id", "tokens", 512).orderBy("chunk").collect()
    assert [len(r.tokens) for r in ch] == [512, 512, 76]
    assert sum((r.tokens for r in ch), []) == list(map(str, range(1100)))


def test_hashing_encoder_matches_xxhash(spark):
    import xxhash

    df = spark.createDataFrame([(1, "alpha beta beta")], "doc_id INT, text STRING")
    v = X.embed_texts(df, "doc_id", "text", dim=8).collect()[0].embedding
    exp = np.zeros(8)
    for tok in ["alpha", "beta", "beta"]:
        h = xxhash.xxh64_intdigest(tok.encode(), seed=42)
        h = h - (1 << 64) if h >= (1 << 63) else h
        sgn = 1.0 if ((h >> 32) % 2) == 0 else -1.0
        exp[h % 8] += sgn
    exp = exp / np.linalg.norm(exp)
    assert np.allclose(v, exp)


def test_coassociation_hand_case(spark):
    """FIXTURES C.6: always together -> 1, never together -> 0, never sampled together -> NULL."""
    sampled = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 4)], "perm INT, id INT")
    labels = spark.createDataFrame(
        [(0, 2, 1, 0), (0, 2, 2, 0), (0, 2, 3, 1), (1, 2, 1, 0), (1, 2, 2, 0), (1, 2, 4, 1)], "perm INT, k INT, id INT, cluster INT"
    )
    c = {(r.i, r.j): r.consensus for r in K.coassociation_matrix(labels, sampled, [2]).collect()}
    assert c[(1, 2)] == 1.0 and c[(1, 3)] == 0.0 and c[(1, 4)] == 0.0
    assert c[(3, 4)] is None  # never sampled together: no value


def _dip(x):
    return dip(*np.unique(np.asarray(x, float), return_counts=True))


def _dip_by_definition(x):
    """Smallest d for which some mode leaves room for a convex and a concave part: hulls by all chords."""
    v, c = np.unique(np.asarray(x, float), return_counts=True)
    after = np.cumsum(c) / c.sum()
    before = np.append(0, after[:-1])

    def hull(px, py, sign):
        out = []
        for k in range(len(px)):
            chords = [py[i] + (py[j] - py[i]) * (px[k] - px[i]) / (px[j] - px[i]) for i in range(k) for j in range(k + 1, len(px))]
            out.append(min([sign * py[k], *[sign * y for y in chords]]) * sign)
        return np.array(out)

    worst = []
    for m in range(len(v)):
        left = (after[:m] - hull(v[: m + 1], before[: m + 1], 1)[:m]).max(initial=0)
        right = (hull(v[m:], after[m:], -1)[1:] - before[m + 1 :]).max(initial=0)
        worst.append(max(left, right))
    return min(worst) / 2


def test_dip_cases():
    """FIXTURES C.7: all equal -> 0, fewer than 4 -> 0, two groups -> large, uniform -> small."""
    assert _dip([1, 1, 1, 1, 1]) == 0.0
    assert _dip([1, 2, 3]) == 0.0
    assert _dip([0] * 50 + [1] * 50) == pytest.approx(0.25)
    assert _dip(range(20)) == pytest.approx(1 / 40)
    rng = np.random.default_rng(3)
    assert _dip(rng.uniform(size=1000)) < 0.02
    assert _dip(np.r_[rng.normal(0, 1, 500), rng.normal(8, 1, 500)]) > 0.05
    for n in (5, 12, 30):
        for x in (rng.uniform(size=n), rng.integers(0, 6, n), np.r_[rng.normal(0, 1, n), rng.normal(6, 1, n // 2)]):
            if len(np.unique(x)) > 1:
                assert _dip(x) == pytest.approx(_dip_by_definition(x))


def test_dip_test_significance(spark):
    rng = np.random.default_rng(5)
    rows = [("uni", float(x)) for x in rng.uniform(size=300)] + [("two", float(x)) for x in np.r_[rng.normal(0, 1, 150), rng.normal(9, 1, 150)]]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    res = {r.g: r for r in K.dip_test(df, "g", "v", nboot=50).collect()}
    assert res["two"].dip_p < 0.05 and res["uni"].dip_p > 0.05


def test_bimodality_matches_formula(spark):
    x = np.array([1.0, 2, 3, 4, 10, 11, 15, 2.5])
    df = spark.createDataFrame([("g", float(v)) for v in x], "g STRING, v DOUBLE")
    got = K.bimodality_coefficient(df, "g", "v").collect()[0].bc
    n = len(x)
    m = x.mean()
    m2, m3, m4 = (((x - m) ** p).mean() for p in (2, 3, 4))
    G1 = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    Kc = 3 + (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / m2**2 - 3 * (n - 1))
    assert got == pytest.approx((G1**2 + 1) / (Kc * (n - 1) ** 2 / ((n - 2) * (n - 3))))


def test_pac_bounds(spark):
    df = spark.createDataFrame([(2, v) for v in [0.0, 0.05, 0.5, 0.95, 1.0]], "k INT, consensus DOUBLE")
    # F(first >= 0.9) = 4/5, F(last <= 0.1) = 2/5
    assert K.pac(df).collect()[0].pac == pytest.approx(0.4)


def test_noise_variance(spark):
    """White noise of sd 2 on a line; a series below five values has no estimate."""
    rng = np.random.default_rng(0)
    rows = [("w", i, float(x)) for i, x in enumerate(rng.normal(0, 2.0, 800) + np.linspace(0, 50, 800))] + [("s", i, 1.0 * i) for i in range(4)]
    got = {r.g: r for r in SEL.noise_variance(spark.createDataFrame(rows, "g STRING, t INT, x DOUBLE"), "g", "t", "x").collect()}
    assert got["w"].noise_var == pytest.approx(4.0, rel=0.2) and got["w"].status == "ok"
    assert got["s"].noise_var is None and got["s"].status == "short"


def test_peaks(spark):
    rows = [("a", i, float(y)) for i, y in enumerate([0, 2, 2, 1, 3, 1])] + [("b", i, float(y)) for i, y in enumerate([3, 2, 1, 1])]
    got = SEL._peaks(spark.createDataFrame(rows, "subject STRING, pos INT, y DOUBLE"), "subject", "y", "p").filter("p").collect()
    assert sorted((r.subject, r.pos) for r in got) == [("a", 1), ("a", 4)]


def _evaluation(spark, dip, pac, bc, p=None):
    rows = [("s", k + 2, float(a), float(b), float(d), 0.0 if p is None else p[k]) for k, (a, b, d) in enumerate(zip(pac, bc, dip))]
    return spark.createDataFrame(rows, "subject STRING, k INT, pac DOUBLE, bc DOUBLE, dip DOUBLE, dip_p DOUBLE")


def test_solution_select(spark):
    """The dip falls by steps and is flat from position 7 on; the last good PAC peak before wins."""
    dip_ = [0.9, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]
    pac = [0.5, 0.2, 0.4, 0.21, 0.5, 0.6, 0.6, 0.01, 0.5, 0.5, 0.5, 0.5]
    r = _evaluation(spark, dip_, pac, [1 - x for x in pac])
    got = SEL.solution_select(r, sigma_tol=0.001, auto_fac=1.5).first()
    assert (got.plateau, got.loc_opt, got.glob_opt_pac) == (8, 5, 3)
    assert got.pre_r_pac_bc == pytest.approx(-1) and got.status == "ok"
    # nothing significant: no choice
    none = SEL.solution_select(_evaluation(spark, dip_, pac, pac, [1.0] * 12)).first()
    assert (none.loc_opt, none.glob_opt_pac, none.plateau) == (0, 0, 0)
    assert SEL.solution_select(_evaluation(spark, dip_, [0.0] * 12, pac)).first().status == "no data"
    for rule in ("inflection", "inflection noise"):
        assert SEL.solution_select(r, rule=rule).first().plateau >= 2
    with pytest.raises(ValueError):
        SEL.solution_select(r, rule="none")


@pytest.mark.parametrize("algo,metric", [("kmeans", "cosine"), ("pam", "eta")])
def test_consensus_cluster_finds_planted_groups(spark, algo, metric):
    rng = np.random.default_rng(4)
    base = np.eye(3, 8) * 5
    sv = [(p, i, [float(v) for v in base[i % 3] + rng.normal(0, 0.1, 8)]) for p in range(2) for i in range(p, 15)]
    df = spark.createDataFrame(sv, "perm INT, id INT, vec ARRAY<DOUBLE>")
    got = K.consensus_cluster(df, [1, 3, 99], algo, metric, reps=12, max_iter=20).collect()
    assert {r.k for r in got} == {1, 3} and len(got) == 2 * (15 + 14)
    for p in range(2):
        lab = {r.id: r.cluster for r in got if r.perm == p and r.k == 3}
        assert len({(i % 3, c) for i, c in lab.items()}) == 3
    for wrong in ({"algo": "hierarchic"}, {"metric": "hamming"}):
        with pytest.raises(ValueError):
            K.consensus_cluster(df, [2], **wrong)


@pytest.mark.parametrize("algo,metric", [("kmeans", "cosine"), ("kmeans", "eta"), ("pam", "euclidean")])
def test_tasks_and_rounds_cluster_alike(spark, algo, metric):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(14, 4))
    rows = [(p, i, vectors[i].tolist()) for p in range(3) for i in range(14) if (i + p) % 4]
    sv = spark.createDataFrame(rows, "perm INT, id INT, vec ARRAY<DOUBLE>")
    found = [sorted(map(tuple, K.consensus_cluster(sv, [2, 4, 99], algo, metric, max_iter=12, reps=3, task_values=most).collect())) for most in (10_000, 0)]
    assert found[0] == found[1] and len(found[0]) == 2 * len(rows)


def test_empty_subsamples(spark):
    assert K.consensus_cluster(spark.createDataFrame([], "perm INT, id INT, vec ARRAY<DOUBLE>"), [2]).count() == 0


@pytest.mark.parametrize("metric", K.METRICS)
def test_matrix_distances_equal_the_expressions(spark, metric):
    rng = np.random.default_rng(13)
    v = np.vstack([rng.normal(size=(5, 3)), np.zeros(3), np.ones(3)])
    df = spark.createDataFrame([(i, j, v[i].tolist(), v[j].tolist()) for i in range(7) for j in range(7)], "i INT, j INT, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    m = K.distances_to(v, v, metric)
    for r in df.select("i", "j", K.distance("a", "b", metric).alias("d")).collect():
        assert m[r.i, r.j] == pytest.approx(r.d, abs=1e-7)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 12])
def test_affinity_gives_exactly_k(spark, k):
    from citegraph.operators.affinity import affinity_propagation_k

    rng = np.random.default_rng(k)
    x = np.r_[[rng.normal(c, 0.2, 2) for c in (0, 3, 6, 9) for _ in range(3)]]
    rows = [(i, j, -float(((x[i] - x[j]) ** 2).sum())) for i in range(12) for j in range(12) if i != j]
    sim = spark.createDataFrame(rows, "i INT, j INT, s DOUBLE")
    got = affinity_propagation_k(sim, k).collect()
    assert len(got) == 12 and all(r.exact for r in got) and len({r.exemplar for r in got}) == k


def test_assign_points_needs_every_label(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id INT, vec ARRAY<DOUBLE>")
    cents = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.1, 1.0])], "cluster INT, centroid ARRAY<DOUBLE>")
    lab = spark.createDataFrame([(0, 7), (1, 9)], "cluster INT, final_cluster INT")
    assert {(r.id, r.final_cluster) for r in K.assign_points(pts, cents, lab).collect()} == {(1, 7), (2, 9)}
    for block in (1, 4_000_000):  # one block for each centroid, one for all
        assert {(r.id, r.centroid) for r in K.nearest_centroid(pts, cents, block_values=block).collect()} == {(1, 0), (2, 1)}
    with pytest.raises(Exception, match="no label for centroid"):
        K.assign_points(pts, cents, lab.filter("cluster = 0")).collect()


def _np_messages(S, pref, iters, damping=0.9):
    n = len(S)
    S2 = S.copy()
    np.fill_diagonal(S2, pref)
    A = np.zeros((n, n))
    R = np.zeros((n, n))
    idx = np.arange(n)
    for _ in range(iters):
        AS = A + S2
        I = AS.argmax(1)
        Y = AS[idx, I]
        AS[idx, I] = -np.inf
        Y2 = AS.max(1)
        Rn = S2 - Y[:, None]
        Rn[idx, I] = S2[idx, I] - Y2
        R = damping * R + (1 - damping) * Rn
        Rp = np.maximum(R, 0)
        Rp[idx, idx] = R[idx, idx]
        An = Rp.sum(0)[None, :] - Rp
        dA = An[idx, idx].copy()
        An = np.minimum(An, 0)
        An[idx, idx] = dA
        A = damping * A + (1 - damping) * An
    return S2, R, A


def test_affinity_rounds_match_numpy(spark):
    from citegraph.operators.affinity import _labels, _rounds

    rng = np.random.default_rng(1)
    P = np.r_[rng.normal(0, 0.3, (4, 2)), rng.normal(5, 0.3, (4, 2))]
    S = -((P[:, None, :] - P[None, :, :]) ** 2).sum(-1)
    pref = float(np.median(S[~np.eye(8, dtype=bool)]))
    rows = [(0, i, j, float(S[i, j]) if i != j else pref, 0.0, 0.0) for i in range(8) for j in range(8)]
    st = _rounds(spark.createDataFrame(rows, "p INT, i INT, j INT, s DOUBLE, r DOUBLE, a DOUBLE"), 0.9, 20, 1000, 10)
    _, R, A = _np_messages(S, pref, 20)
    for r in st.collect():
        assert r.r == pytest.approx(R[r.i, r.j], abs=1e-9) and r.a == pytest.approx(A[r.i, r.j], abs=1e-9)
    # exemplar assignment on a converged state
    S2, R, A = _np_messages(S, pref, 400)
    conv = [(0, i, j, float(S2[i, j]), float(R[i, j]), float(A[i, j])) for i in range(8) for j in range(8)]
    got = {r.i: r.exemplar for r in _labels(spark.createDataFrame(conv, "p INT, i INT, j INT, s DOUBLE, r DOUBLE, a DOUBLE")).collect()}
    assert len({got[i] for i in range(4)}) == len({got[i] for i in range(4, 8)}) == 1  # the two planted groups
    assert got[0] < 4 <= got[7]
