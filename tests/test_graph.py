import random

import pytest
from pyspark.sql import functions as F

import graph_oracles as GO
from citegraph.operators import centrality as C
from citegraph.operators import graph as G
from citegraph.plans import standins as S
from conftest import SF001

# (year, node1, node2, weight, seq): tie A->D via B or C, isolated X-Y,
# reversed duplicate B-A (last row wins), self-loop E-E.
HAND = [
    (1, "A", "B", 1.0, 0),
    (1, "C", "A", 1.0, 1),
    (1, "B", "D", 1.0, 2),
    (1, "D", "C", 1.0, 3),
    (1, "D", "E", 2.0, 4),
    (1, "X", "Y", 1.0, 5),
    (1, "B", "A", 1.0, 6),
    (1, "E", "E", 5.0, 7),
]


def _random_graph(seed=7, n=25, m=60):
    rnd = random.Random(seed)
    rows, seen = [], set()
    while len(rows) < m:
        a, b = sorted(rnd.sample(range(n), 2))
        if (a, b) in seen:
            continue
        seen.add((a, b))
        rows.append((2, f"n{a:02d}", f"n{b:02d}", float(rnd.randint(1, 4)), len(rows)))
    return rows


@pytest.fixture(scope="module")
def graphs(spark):
    rows = HAND + _random_graph()
    e = spark.createDataFrame(rows, "year INT, node1 STRING, node2 STRING, weight DOUBLE, seq INT")
    simple = G.undirected_simplify(e, "weight", seq="seq").cache()
    py = {}
    for y in (1, 2):
        py[y] = [(r.u, r.v, r.w) for r in simple.filter(F.col("year") == y).collect()]
    return simple, py


def _as_dict(df, col):
    return {(r.year, r.node): getattr(r, col) for r in df.collect()}


def test_simplify_last_wins(spark):
    e = spark.createDataFrame([(1, "A", "B", 1.0, 0), (1, "B", "A", 3.0, 1)], "year INT, node1 STRING, node2 STRING, weight DOUBLE, seq INT")
    r = G.undirected_simplify(e, "weight", seq="seq").collect()
    assert [(x.u, x.v, x.w) for x in r] == [("A", "B", 3.0)]
    s = G.undirected_simplify(e, "weight", how="sum").collect()
    assert s[0].w == 4.0


@pytest.mark.parametrize("metric", ["closeness", "betweenness", "eigenvector", "degree"])
def test_centrality_matches_python(graphs, metric):
    simple, py = graphs
    fn = {
        "closeness": C.closeness_centrality,
        "betweenness": C.betweenness_centrality,
        "eigenvector": C.eigenvector_centrality,
        "degree": G.degree_centrality,
    }[metric]
    got = _as_dict(fn(simple), metric)
    ref = getattr(GO, metric)
    for y in (1, 2):
        exp = ref(py[y])
        for node, val in exp.items():
            assert got[(y, node)] == pytest.approx(val, rel=1e-6, abs=1e-9), (metric, y, node)
        assert {n for (yy, n) in got if yy == y} == set(exp)


def test_tie_of_shortest_paths(graphs):
    simple, _ = graphs
    b = _as_dict(C.betweenness_centrality(simple), "betweenness")
    # B and C each carry half of the A-D paths
    assert b[(1, "B")] == pytest.approx(b[(1, "C")])
    assert b[(1, "X")] == 0.0


def test_salted_pairs_equal_plain(spark):
    oh = S.org_hierarchy(spark, SF001)
    args = ("publication_id", "publication_year", "author_id", "author_name")
    plain = G.cooccurrence_edges(oh, *args)
    salted = G.cooccurrence_edges(oh, *args, hot_rows=2)
    assert plain.count() > 0
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_cii_and_proportion_hand(spark):
    e = spark.createDataFrame([(1, "A", "B", 2), (1, "B", "C", 1), (1, "A", "C", 1)], "year INT, node1 STRING, node2 STRING, weight BIGINT")
    c = {(r.node1, r.node2): r.cii for r in G.cii(e).collect()}
    # strengths A=3 B=3 C=2, total 4: A-B 2/(9/4)
    assert c[("A", "B")] == pytest.approx(2 / (9 / 4))
    p = {(r.node1, r.node2): r.proportional_weight for r in G.proportional_weight(e).collect()}
    assert p[("B", "C")] == pytest.approx(0.5 * (1 / 3 + 1 / 2))


def test_densify_and_normalise(spark):
    e = spark.createDataFrame([(1, "A", "B", 2), (2, "A", "C", 0), (2, "B", "C", 0)], "year INT, node1 STRING, node2 STRING, weight BIGINT")
    dn = G.max_normalise(G.pair_year_densify(e))
    rows = {(r.year, r.node1, r.node2): (r.weight, r.normalized_weight) for r in dn.collect()}
    assert rows[(2, "A", "B")] == (0, 0.0)  # missing pair densified with 0
    assert rows[(1, "A", "B")] == (2, 1.0)
    assert rows[(2, "A", "C")] == (0, 0.0)  # year maximum 0: unchanged
    assert len(rows) == 6


def test_author_level_of_the_path_centralities(spark):
    import __spark_entry__ as E
    from citegraph.plans.graph_queries import _whole_graph
    from conftest import SF001

    edges = {}
    for r in _whole_graph(spark, SF001, "author").collect():
        edges.setdefault(r["year"], []).append((r["u"], r["v"], r["w"]))
    for name, column, oracle in (("closeness_author", "closeness", GO.closeness), ("betweenness_author", "betweenness", GO.betweenness)):
        want = {(y, n): v for y, e in edges.items() for n, v in oracle(e).items()}
        rows = {(r["year"], r["node"]): r[column] for r in E.queries()[name](spark, SF001).collect()}
        assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-4 for k in want)


@pytest.mark.parametrize("metric", ["closeness", "betweenness"])
def test_paths_within_tasks_equal_those_of_rounds(graphs, metric):
    fn = {"closeness": C.closeness_centrality, "betweenness": C.betweenness_centrality}[metric]
    simple = graphs[0]
    a, b = _as_dict(fn(simple), metric), _as_dict(fn(simple, task_arcs=0), metric)
    assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], abs=1e-12) for x in b)


def test_a_node_without_a_name_keeps_its_row(spark):
    simple = spark.createDataFrame([(1, "a", "b", 1.0), (1, None, None, 1.0)], "year INT, u STRING, v STRING, w DOUBLE")
    for task_arcs in (0, 100):
        got = _as_dict(C.closeness_centrality(simple, task_arcs=task_arcs), "closeness")
        assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (1, None): 0.0}


@pytest.mark.parametrize("metric", ["closeness", "betweenness"])
def test_paths_of_several_cells_equal_those_within_tasks(graphs, metric):
    fn = {"closeness": C.closeness_centrality, "betweenness": C.betweenness_centrality}[metric]
    simple = graphs[0]
    a, b = _as_dict(fn(simple, sources=5), metric), _as_dict(fn(simple, sources=5, task_arcs=0, cell_edges=40, in_flight=1), metric)
    assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], abs=1e-12) for x in b)


def test_a_round_sends_a_row_for_a_cell_and_node_and_not_for_an_arc(spark):
    rows = [(1, f"n{i:02}", f"n{j:02}", 1.0 + (i * 7 + j * 3) % 5) for i in range(40) for j in range(i + 1, 40)]
    simple = spark.createDataFrame(rows, "year INT, u STRING, v STRING, w DOUBLE")
    cells = C._into_cells(C._edges(simple, ["year"], positive=True), ["year"], len(rows), 1, 400)
    assert cells.parts == 2 and cells.table.select("p", "q").distinct().count() == 3
    front = spark.createDataFrame([(1, 0, f"n{i:02}", 0.0) for i in range(40)], "year INT, b INT, node STRING, d0 DOUBLE")
    sent = cells.exchange(front, ["d0"], C._nearer)
    assert sent.count() <= 40 * cells.parts < 2 * len(rows)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # what is sent; the cells lie where they are


def test_cells_leave_out_what_is_no_path(spark):
    rows = [(1, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "c", "d", 0.0), (1, "e", "e", 1.0), (None, "a", "b", 1.0), (1, None, "a", 1.0), (2, "x", "y", 1.0)]
    simple = spark.createDataFrame(rows, "year INT, u STRING, v STRING, w DOUBLE")
    for fn, name in ((C.closeness_centrality, "closeness"), (C.betweenness_centrality, "betweenness")):
        a, b = _as_dict(fn(simple), name), _as_dict(fn(simple, task_arcs=0, cell_edges=1), name)
        assert a == pytest.approx(b) and {n for y, n in b if y == 1} == {"a", "b", "c", "d", "e", None}


def test_strengths_and_simple_edges_in_cells_equal_plain(spark):
    rows = [(y, f"n{i:02}", f"n{j:02}", 1 + (i * j + y) % 4) for y in (1, 2) for i in range(12) for j in range(i + 1, 12)] + [(None, "a", "b", 1), (1, None, "n01", 2), (1, "n03", "n03", 1)]
    e = spark.createDataFrame(rows, "year INT, node1 STRING, node2 STRING, weight BIGINT")
    plain = {tuple(r) for r in G.undirected_simplify(G.cii(e), "cii").collect()}
    dealt = G.cii(e, parts=3)
    simple = G.undirected_simplify(dealt, "cii", by=["year", *G.CELL]).drop(*G.CELL)
    assert simple.columns == ["year", "u", "v", "w"] and {tuple(r) for r in simple.collect()} == plain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        simple = G.undirected_simplify(G.cii(e, parts=3), "cii", by=["year", *G.CELL])
        # the edges move once for both strengths and the pair
        moved = [x for x in simple._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
        assert sum("_p#" in x for x in moved) == 1 and not any("u#" in x or "node1#" in x for x in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _sorted_graph(n, edges):
    import numpy as np

    s, t, w = (np.array(x) for x in zip(*(edges + [(v, u, w) for u, v, w in edges])))
    order = np.lexsort((t, w, s))
    return C._SortedArcs(np.bincount(s, minlength=n).astype("int32"), t[order].astype("int32"), w[order].astype(float))


def test_a_source_looks_at_the_arcs_of_its_surroundings_only(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    n = 600
    # two dense parts without a path between them, lengths within a factor of a few as collaboration strengths have
    edges = [(u, v, 3 + float(rng.lognormal(2, 0.4))) for u in range(n) for v in range(u + 1, n) if u % 2 == v % 2 and rng.random() < 0.3]
    graph = _sorted_graph(n, edges)
    looked, pieces = [0], C._SortedArcs.pieces

    def counted(self, nodes, counts):
        looked[0] += int(counts.sum())
        return pieces(self, nodes, counts)

    monkeypatch.setattr(C._SortedArcs, "pieces", counted)
    want = np.full((n, n), np.inf)
    for u, v, w in edges:
        want[u, v] = want[v, u] = w
    np.fill_diagonal(want, 0)
    for x in range(n):
        want = np.minimum(want, want[:, x, None] + want[x])
    some = range(0, n, 20)
    for source in some:
        assert np.allclose(C._task_distances(graph, source), want[source], rtol=1e-12)
    assert looked[0] < len(some) * 2 * len(edges) / 4  # before: every arc several times for each source


def test_path_arcs_are_found_whatever_their_lengths():
    import numpy as np

    rng = np.random.default_rng(6)
    for lengths in ([1.0], [1.0, 2.0, 3.0], list(10.0 ** rng.uniform(-9, 3, 50))):
        edges = [(u, v, float(rng.choice(lengths))) for u in range(60) for v in range(u + 1, 60) if rng.random() < 0.15]
        graph = _sorted_graph(62, edges)  # the last two without arcs
        for source in (0, 17, 61):
            d = C._task_distances(graph, source)
            back = {(u, v) for a, b, w in edges for u, v in ((a, b), (b, a)) if d[u] + w == d[v] and d[u] < d[v]}
            assert all(any(v == x for _, v in back) for x in np.flatnonzero(np.isfinite(d) & (d > 0)))
            tail, head = C._task_path_arcs(graph, source, d)
            assert len(tail) == len(back) and set(zip(tail.tolist(), head.tolist())) == back
