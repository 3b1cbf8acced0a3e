"""Catalog: co-occurrence edges and non-iterative graph metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.operators import centrality as CE
from citegraph.operators import graph as G
from citegraph.plans import standins as S
from citegraph.plans.common import rounded
from citegraph.plans.registry import register, stage
from citegraph.session import cut_lineage, wide_shuffles
from citegraph.plans.sqlparts import CII, OH, PROP, STRENGTH, edges_sql, with_

# level -> (node id column, node name column or expression, parent id column)
LEVELS = {
    "author": ("author_id", "author_name", None),
    "org": ("org_id", "organization_name", None),
    "country": ("country_name", "country_name", None),
    "high": ("high_level_org_id", "high_level_org_name", None),
    "low": (
        "low_level_org_id",
        lambda: F.concat(F.col("low_level_org_name"), F.lit(" ("), F.col("high_level_org_name"), F.lit(")")),
        "high_level_org_id",
    ),
}

# fixed parameters of the reference
OFFLINE_THRESHOLD = 3


def edges(spark: SparkSession, d: str, level: str) -> DataFrame:
    """Co-occurrence edge table of one level, built once per session and kept as a
    checkpointed table (the reference stores these matrices as tables too)."""

    def build():
        node_id, name, parent = LEVELS[level]
        name = name() if callable(name) else name
        oh = S.org_hierarchy(spark, d)
        with wide_shuffles(spark, S.table(spark, d, "lineitem").count()):
            return cut_lineage(G.cooccurrence_edges(oh, "publication_id", "publication_year", node_id, name, parent))

    return stage(spark, d, f"edges_{level}", build)


def _q(sql_level: str, body: str, *parts: str) -> str:
    return with_(OH, edges_sql(sql_level), *parts) + body


# ------------------------------------------------------------------ flagship


@register(
    "org_collab_cii",
    _q("org", "SELECT year, node1, node2, weight, ROUND(cii, 6) AS cii FROM ci WHERE weight >= 3 ORDER BY year, node1, node2", STRENGTH, CII),
)
def org_collab_cii(spark, d):
    """Organisation co-occurrence edges per year with CII, weight >= 3, sorted (#47, #75, #102, #20, #96)."""
    e = G.cii(edges(spark, d, "org"))
    e = G.weight_threshold(e, "weight", OFFLINE_THRESHOLD)
    return rounded(e.select("year", "node1", "node2", "weight", "cii")).orderBy("year", "node1", "node2")


# ------------------------------------------------------------- edge building


@register("cooccurrence_self_join", _q("author", "SELECT * FROM e"))
def cooccurrence_self_join(spark, d):
    return edges(spark, d, "author")


@register("cooccurrence_country", _q("country", "SELECT * FROM e"))
def cooccurrence_country(spark, d):
    return edges(spark, d, "country")


@register("cooccurrence_high_level", _q("high", "SELECT * FROM e"))
def cooccurrence_high_level(spark, d):
    return edges(spark, d, "high")


@register("cooccurrence_within_parent", _q("low", "SELECT * FROM e"))
def cooccurrence_within_parent(spark, d):
    return edges(spark, d, "low")


@register(
    "pair_year_densify",
    _q(
        "org",
        """SELECT y.year, p.node1, p.node2, CAST(COALESCE(e.weight, 0) AS BIGINT) AS weight
FROM (SELECT DISTINCT node1, node2 FROM e) p CROSS JOIN (SELECT DISTINCT year FROM e) y
LEFT JOIN e ON e.year = y.year AND e.node1 = p.node1 AND e.node2 = p.node2""",
    ),
)
def pair_year_densify(spark, d):
    return G.pair_year_densify(edges(spark, d, "org"))


@register(
    "max_normalise",
    _q(
        "org",
        """, dn AS (SELECT y.year, p.node1, p.node2, CAST(COALESCE(e.weight, 0) AS BIGINT) AS weight
FROM (SELECT DISTINCT node1, node2 FROM e) p CROSS JOIN (SELECT DISTINCT year FROM e) y
LEFT JOIN e ON e.year = y.year AND e.node1 = p.node1 AND e.node2 = p.node2)
SELECT dn.year, node1, node2, weight,
       ROUND(CASE WHEN m.mx > 0 THEN CAST(weight AS DOUBLE) / m.mx ELSE CAST(weight AS DOUBLE) END, 6) AS normalized_weight
FROM dn JOIN (SELECT year, MAX(weight) AS mx FROM dn GROUP BY year) m ON m.year = dn.year""",
    ).replace("\n, dn AS", ", dn AS").replace(")\n, dn", "), dn"),
)
def max_normalise(spark, d):
    return rounded(G.max_normalise(G.pair_year_densify(edges(spark, d, "org"))))


# ---------------------------------------------------------------- metrics


@register("node_strength", _q("author", "SELECT * FROM st", STRENGTH))
def node_strength(spark, d):
    return G.node_strength(edges(spark, d, "author"))


@register(
    "proportional_weight",
    _q("author", "SELECT year, node1, node2, weight, ROUND(proportional_weight, 6) AS proportional_weight FROM pw", STRENGTH, PROP),
)
def proportional_weight(spark, d):
    return rounded(G.proportional_weight(edges(spark, d, "author")))


@register("cii", _q("author", "SELECT year, node1, node2, weight, ROUND(cii, 6) AS cii FROM ci", STRENGTH, CII))
def cii(spark, d):
    return rounded(G.cii(edges(spark, d, "author")))


@register(
    "weight_metric_select",
    _q(
        "org",
        "SELECT year, node1, node2, weight, ROUND(proportional_weight, 6) AS proportional_weight, "
        "ROUND(proportional_weight, 6) AS computed_weight FROM pw",
        STRENGTH,
        PROP,
    ),
)
def weight_metric_select(spark, d):
    return rounded(G.weight_metric_select(edges(spark, d, "org"), "proportion"))


@register("weight_threshold", _q("author", "SELECT * FROM e WHERE weight >= 3"))
def weight_threshold(spark, d):
    return G.weight_threshold(edges(spark, d, "author"), "weight", OFFLINE_THRESHOLD)


@register(
    "edges_remaining",
    _q(
        "author",
        "SELECT year, COUNT(*) FILTER (WHERE weight >= 1) AS edges_ge_1, COUNT(*) FILTER (WHERE weight >= 2) AS edges_ge_2, "
        "COUNT(*) FILTER (WHERE weight >= 3) AS edges_ge_3, COUNT(*) FILTER (WHERE weight >= 5) AS edges_ge_5, "
        "COUNT(*) AS edges_total FROM e GROUP BY year",
    ),
)
def edges_remaining(spark, d):
    return G.edges_remaining(edges(spark, d, "author"), [1, 2, 3, 5])


# Simple graph of the thresholded author CII network. Author pairs are
# unique per year, so the canonical pair view never merges two rows here.
SIMPLE = """g AS (SELECT year, LEAST(node1, node2) AS u, GREATEST(node1, node2) AS v, cii AS w FROM ci WHERE cii >= 1.0)"""


def _simple(spark, d):
    def build():
        e = edges(spark, d, "author")
        with wide_shuffles(spark, e.count()):
            return cut_lineage(G.undirected_simplify(G.weight_threshold(G.cii(e), "cii", 1.0), "cii"))

    return stage(spark, d, "simple_author", build)


@register("undirected_simplify", _q("author", "SELECT year, u, v, ROUND(w, 6) AS w FROM g", STRENGTH, CII, SIMPLE))
def undirected_simplify(spark, d):
    return rounded(_simple(spark, d))


@register(
    "degree_centrality",
    _q(
        "author",
        """, dg AS (SELECT year, node, COUNT(*) AS deg FROM (SELECT year, u AS node FROM g UNION ALL SELECT year, v FROM g) x GROUP BY year, node)
SELECT dg.year, node, ROUND(COALESCE(CAST(deg AS DOUBLE) / NULLIF(n.n - 1, 0), 1.0), 6) AS degree
FROM dg JOIN (SELECT year, COUNT(*) AS n FROM dg GROUP BY year) n ON n.year = dg.year""",
        STRENGTH,
        CII,
        SIMPLE,
    ).replace("\n, dg AS", ", dg AS"),
)
def degree_centrality(spark, d):
    return rounded(G.degree_centrality(_simple(spark, d)))


@register(
    "node_cii_strength",
    _q(
        "author",
        "SELECT year, node, ROUND(SUM(w), 6) AS node_cii FROM (SELECT year, u AS node, w FROM g UNION ALL SELECT year, v, w FROM g) x GROUP BY year, node",
        STRENGTH,
        CII,
        SIMPLE,
    ),
)
def node_cii_strength(spark, d):
    return rounded(G.node_metric_strength(_simple(spark, d)))


@register(
    "scale_to_range",
    _q(
        "author",
        """, nc AS (SELECT year, node, SUM(w) AS node_cii FROM (SELECT year, u AS node, w FROM g UNION ALL SELECT year, v, w FROM g) x GROUP BY year, node)
SELECT nc.year, node, ROUND(node_cii, 6) AS node_cii,
       ROUND(CASE WHEN mx - mn <> 0 THEN 10 + 30 * (node_cii - mn) / (mx - mn) ELSE 20 END, 6) AS scaled
FROM nc JOIN (SELECT year, MIN(node_cii) AS mn, MAX(node_cii) AS mx FROM nc GROUP BY year) m ON m.year = nc.year""",
        STRENGTH,
        CII,
        SIMPLE,
    ).replace("\n, nc AS", ", nc AS"),
)
def scale_to_range(spark, d):
    nodes = G.node_metric_strength(_simple(spark, d))
    return rounded(G.scale_to_range(nodes, "node_cii", 10.0, 40.0, 20.0))


@register(
    "top_n_subgraph",
    _q(
        "author",
        """, rk AS (SELECT year, node, ROW_NUMBER() OVER (PARTITION BY year ORDER BY strength DESC, node) AS r FROM st)
SELECT e.* FROM e
WHERE EXISTS (SELECT 1 FROM rk WHERE rk.year = e.year AND rk.node = e.node1 AND rk.r <= 20)
  AND EXISTS (SELECT 1 FROM rk WHERE rk.year = e.year AND rk.node = e.node2 AND rk.r <= 20)""",
        STRENGTH,
    ).replace("\n, rk AS", ", rk AS"),
)
def top_n_subgraph(spark, d):
    return G.top_n_subgraph(edges(spark, d, "author"), 20)


# Mapping country -> organisation (region -> nation) from the stand-in hierarchy.
MAP = """mp AS (SELECT DISTINCT country_name, organization_name AS org FROM oh)"""


def _mapping(spark, d):
    oh = S.org_hierarchy(spark, d)
    return oh.select("country_name", F.col("organization_name").alias("org")).distinct()


@register(
    "country_org_view",
    _q(
        "org",
        """SELECT DISTINCT mp.country_name, e.year, e.node1, e.node2, e.weight
FROM e JOIN mp ON mp.org = e.node1 OR mp.org = e.node2""",
        MAP,
    ),
)
def country_org_view(spark, d):
    return G.country_org_view(edges(spark, d, "org"), _mapping(spark, d))


@register(
    "country_org_view_faithful",
    _q(
        "org",
        """SELECT mp.country_name, x.year, x.node1, x.node2, x.weight
FROM (SELECT year, node1, node2, weight, node1 AS org FROM e UNION ALL SELECT year, node1, node2, weight, node2 FROM e) x
JOIN mp ON mp.org = x.org""",
        MAP,
    ),
)
def country_org_view_faithful(spark, d):
    return G.country_org_view(edges(spark, d, "org"), _mapping(spark, d), dedup=False)


@register(
    "within_country_edges",
    _q(
        "org",
        """SELECT e.node2, m1.country_name, e.year, e.node1, e.weight
FROM e JOIN mp m1 ON m1.org = e.node1 JOIN mp m2 ON m2.org = e.node2 AND m2.country_name = m1.country_name""",
        MAP,
    ),
)
def within_country_edges(spark, d):
    return G.within_country_edges(edges(spark, d, "org"), _mapping(spark, d))


@register(
    "incident_edges",
    _q(
        "org",
        """SELECT year, node1, node2, weight, CASE WHEN node1 = 'NATION_7' THEN node2 ELSE node1 END AS neighbour
FROM e WHERE (node1 = 'NATION_7' OR node2 = 'NATION_7') AND node1 <> node2""",
    ),
)
def incident_edges(spark, d):
    return G.incident_edges(edges(spark, d, "org"), "NATION_7")


@register(
    "edge_metric_table",
    _q(
        "org",
        """, nc AS (SELECT year, node, SUM(cii) AS node_cii FROM (SELECT year, node1 AS node, cii FROM ci WHERE cii >= 0.5
                   UNION ALL SELECT year, node2, cii FROM ci WHERE cii >= 0.5) x GROUP BY year, node)
SELECT c.year, CASE WHEN node1 = 'NATION_7' THEN node2 ELSE node1 END AS neighbour, m.country_name,
       ROUND(c.cii, 6) AS edge_metric, ROUND(COALESCE(nc.node_cii, 0.0), 6) AS node_metric
FROM ci c LEFT JOIN nc ON nc.year = c.year AND nc.node = CASE WHEN node1 = 'NATION_7' THEN node2 ELSE node1 END
LEFT JOIN (SELECT organization_name, MIN(country_name) AS country_name FROM oh GROUP BY 1) m ON m.organization_name = CASE WHEN node1 = 'NATION_7' THEN node2 ELSE node1 END
WHERE c.cii >= 0.5 AND (node1 = 'NATION_7' OR node2 = 'NATION_7') AND node1 <> node2""",
        STRENGTH,
        CII,
    ).replace("\n, nc AS", ", nc AS"),
)
def edge_metric_table(spark, d):
    e = G.cii(edges(spark, d, "org"))
    simple = G.undirected_simplify(G.weight_threshold(e, "cii", 0.5), "cii")
    nodes = G.node_metric_strength(simple)
    where = S.org_hierarchy(spark, d).groupBy(F.col("organization_name").alias("node")).agg(F.min("country_name").alias("country_name"))
    return rounded(G.edge_metric_table(e, "NATION_7", "cii", nodes, "node_cii", 0.5, mapping=where))


_AUTHOR = "'Supplier#000000001'"


@register(
    "edge_metric_table_author",
    _q(
        "author",
        f""", ns AS (SELECT year, node, SUM(weight) AS strength FROM (SELECT year, node1 AS node, weight FROM e UNION ALL SELECT year, node2, weight FROM e) x GROUP BY 1, 2)
SELECT e.year, b.author_name AS neighbour, b.organization_name, b.country_name, CAST(e.weight AS BIGINT) AS edge_metric, CAST(ns.strength AS DOUBLE) AS node_metric
FROM e JOIN (SELECT author_name, MIN(organization_name) AS organization_name, MIN(country_name) AS country_name FROM oh GROUP BY 1) b
  ON b.author_name = CASE WHEN node1 = {_AUTHOR} THEN node2 ELSE node1 END
JOIN ns ON ns.year = e.year AND ns.node = b.author_name
WHERE (node1 = {_AUTHOR} OR node2 = {_AUTHOR}) AND node1 <> node2""",
    ).replace("\n, ns AS", ", ns AS"),
)
def edge_metric_table_author(spark, d):
    """An author's co-authors with their organisation, country, joint publications and strength, strongest first."""
    e = edges(spark, d, "author")
    where = S.org_hierarchy(spark, d).groupBy(F.col("author_name").alias("node")).agg(F.min("organization_name").alias("organization_name"), F.min("country_name").alias("country_name"))
    return G.edge_metric_table(e, _AUTHOR.strip("'"), "weight", G.node_strength(e, "weight"), "strength", 0, mapping=where)


# ------------------------------------------------------ iterative centralities
# The metrics run on whole graphs; the author page's composition (the
# strongest nodes first, then weights and the simple graph) has its own queries.
TOP_AUTHORS = 50
#: edges of a year that a task holds on average to get its nodes' strengths
CELL_EDGES = 500_000


def _whole_graph(spark, d, level):
    def build():
        e = edges(spark, d, level)
        rows = e.groupBy("year").count().agg(F.sum("count"), F.max("count")).first()
        parts = math.ceil(math.sqrt(2 * (rows[1] or 1) / CELL_EDGES))
        with wide_shuffles(spark, rows[0] or 0):
            simple = G.undirected_simplify(G.cii(e, parts=parts), "cii", by=["year", *G.CELL])
            return cut_lineage(simple.drop(*G.CELL))

    return stage(spark, d, f"whole_{level}", build)


def _author_page_graph(spark, d):
    return G.undirected_simplify(G.cii(G.top_n_subgraph(edges(spark, d, "author"), TOP_AUTHORS)), "cii")


@register("eigenvector_centrality")
def eigenvector_centrality(spark, d):
    """Power-iteration centrality of every year's whole author graph (checked against a Python oracle in tests)."""
    return rounded(CE.eigenvector_centrality(_whole_graph(spark, d, "author")))


def _closeness_author(spark, d):
    return stage(spark, d, "closeness_author", lambda: cut_lineage(rounded(CE.closeness_centrality(_whole_graph(spark, d, "author")))))


def _betweenness_author(spark, d):
    return stage(spark, d, "betweenness_author", lambda: cut_lineage(rounded(CE.betweenness_centrality(_whole_graph(spark, d, "author")))))


@register("closeness_centrality")
def closeness_centrality(spark, d):
    """Shortest-path closeness (edge CII as distance) of every year's whole author graph (checked against a Python oracle in tests)."""
    return _closeness_author(spark, d)


@register("betweenness_centrality")
def betweenness_centrality(spark, d):
    """Brandes betweenness (edge CII as distance) of every year's whole author graph (checked against a Python oracle in tests)."""
    return _betweenness_author(spark, d)


@register("closeness_author")
def closeness_author(spark, d):
    """The rows of ``closeness_centrality`` under the name of its level."""
    return _closeness_author(spark, d)


@register("betweenness_author")
def betweenness_author(spark, d):
    """The rows of ``betweenness_centrality`` under the name of its level."""
    return _betweenness_author(spark, d)


@register("closeness_org")
def closeness_org(spark, d):
    """Closeness of every year's whole organisation graph, 1 / CII as distance: strong ties are short."""
    return rounded(CE.closeness_centrality(_whole_graph(spark, d, "org"), inverse=True))


@register("betweenness_org")
def betweenness_org(spark, d):
    """Betweenness of every year's whole organisation graph (edge CII as distance)."""
    return rounded(CE.betweenness_centrality(_whole_graph(spark, d, "org")))


@register("betweenness_sampled")
def betweenness_sampled(spark, d):
    """Betweenness of every year's author graph, estimated from the paths of 16 authors a year."""
    return rounded(CE.betweenness_centrality(_whole_graph(spark, d, "author"), sources=16))


@register("closeness_author_page")
def closeness_author_page(spark, d):
    """Closeness of the author page's subgraph of the 50 strongest authors of a year."""
    return rounded(CE.closeness_centrality(_author_page_graph(spark, d)))


@register("betweenness_author_page")
def betweenness_author_page(spark, d):
    """Betweenness of the author page's subgraph of the 50 strongest authors of a year."""
    return rounded(CE.betweenness_centrality(_author_page_graph(spark, d)))


@register(
    "cooccurrence_by_id",
    with_(OH)
    + """SELECT a.publication_year AS year, CAST(a.author_id AS VARCHAR) AS node1, CAST(b.author_id AS VARCHAR) AS node2,
  COUNT(DISTINCT a.publication_id) AS weight
FROM oh a JOIN oh b ON a.publication_id = b.publication_id WHERE a.author_id < b.author_id GROUP BY 1, 2, 3""",
)
def cooccurrence_by_id(spark, d):
    """Author co-occurrence grouped by the canonical id pair (the corrected variant)."""
    oh = S.org_hierarchy(spark, d)
    with wide_shuffles(spark, S.table(spark, d, "lineitem").count()):
        return cut_lineage(G.cooccurrence_edges(oh, "publication_id", "publication_year", "author_id", "author_name", group_by="id"))
