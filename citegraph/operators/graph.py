"""Collaboration graphs as edge DataFrames.

An edge table ``E`` has columns ``(year, node1, node2, weight)``; every graph
operator is evaluated for all graph partitions at once (``by`` = the columns
that identify one graph, ``["year"]`` by default), never one year at a time
on the driver. Per-graph scalars (total weight, maximum, node count) are
computed with ``groupBy`` and joined back; the number of graph partitions
(years x levels) is tiny, so these joins are broadcast. Windows partitioned
by year alone are avoided, since they would place a whole year in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.operators.skew import pairs_within_groups
from citegraph.session import cut_lineage

EDGE_COLS = ["year", "node1", "node2", "weight"]
#: the cell of an edge: the parts of its two nodes, the lesser first
CELL = ["_p", "_q"]

def _by(by) -> list[str]:
    if by is None:
        return ["year"]
    return [by] if isinstance(by, str) else list(by)


def per_graph(df: DataFrame) -> DataFrame:
    """A table with one row per graph; the optimiser broadcasts it by its measured size."""
    return df


# ---------------------------------------------------------------- building


def cooccurrence_edges(
    members: DataFrame,
    pub: str,
    year: str,
    node_id: str,
    node_name: str | Column,
    parent_id: str | None = None,
    hot_rows: int | None = None,
    group_by: str = "name",
) -> DataFrame:
    """Co-occurrence edges (#47, #48).

    Two nodes are linked in a year when they occur on the same publication;
    the pair is ordered by node id (``a.id < b.id``) and the weight is the
    number of distinct publications, grouped by the node *names* (as the
    reference does, so (A, B) and (B, A) can both appear when names and ids
    sort differently); ``group_by='id'`` groups by the canonical id pair
    instead and names the nodes by id. With ``parent_id`` both nodes must
    share the parent. ``members`` may hold repeats; they are removed before
    pairing.
    """
    name_col = node_name if isinstance(node_name, Column) else F.col(node_name)
    group = [pub, year] + ([parent_id] if parent_id else [])
    m = members.select(
        *[F.col(c) for c in group], F.col(node_id).alias("_id"), name_col.alias("_name")
    ).dropDuplicates()
    # the deduplicated membership table is read three times (group sizes and
    # both sides of the pairing): write it once instead of recomputing the scan
    m = cut_lineage(m)
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    pairs = pairs_within_groups(m, group, "_id", ["_id", "_name"], ["_id", "_name"], **kw)
    if group_by == "id":
        return pairs.groupBy(
            F.col(year).alias("year"),
            F.col("l__id").cast("string").alias("node1"),
            F.col("r__id").cast("string").alias("node2"),
        ).agg(F.countDistinct(pub).alias("weight"))
    return pairs.groupBy(
        F.col(year).alias("year"), F.col("l__name").alias("node1"), F.col("r__name").alias("node2")
    ).agg(F.countDistinct(pub).alias("weight"))


def pair_year_densify(edges: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Every pair ever seen (per ``group_cols``) x every observed year, weight 0 when absent (#56).

    The year list is one scalar value (its length is the number of distinct
    years), exploded on each pair.
    """
    g = group_cols or []
    years = edges.agg(F.sort_array(F.collect_set("year")).alias("_years")).scalar()
    pairs = edges.select(*g, "node1", "node2").distinct()
    grid = pairs.select(*g, "node1", "node2", F.explode(years).alias("year"))
    return grid.join(edges, [*g, "year", "node1", "node2"], "left").select(
        *g, "year", "node1", "node2", F.coalesce(F.col("weight"), F.lit(0)).cast("bigint").alias("weight")
    )


def max_normalise(edges: DataFrame, by=None, col: str = "weight", out: str = "normalized_weight") -> DataFrame:
    """``col / max(col)`` per graph partition; unchanged when the maximum is 0 (#90)."""
    keys = _by(by)
    mx = edges.groupBy(*keys).agg(F.max(col).alias("_max"))
    return edges.join(per_graph(mx), keys).withColumn(
        out,
        F.when(F.col("_max") > 0, F.col(col) / F.col("_max")).otherwise(F.col(col).cast("double")),
    ).drop("_max")


# ------------------------------------------------------------- edge metrics


def node_strength(edges: DataFrame, metric: str = "weight", by=None, out: str = "strength") -> DataFrame:
    """Total metric per node over both endpoints (#75, #105). One scan, one aggregation."""
    keys = _by(by)
    return (
        edges.select(*keys, F.explode(F.array("node1", "node2")).alias("node"), F.col(metric).alias("_m"))
        .groupBy(*keys, "node")
        .agg(F.sum("_m").alias(out))
    )


def _with_strengths(edges: DataFrame, by, parts: int | None = None) -> DataFrame:
    """``edges`` with the strengths ``_s1`` and ``_s2`` of their nodes.

    With ``parts`` nodes are dealt into so many parts and edges into ``CELL``s,
    one for each pair of parts, which the result names: an edge moves once for
    both strengths, a strength once for each part.
    """
    keys = _by(by)
    s = node_strength(edges, "weight", keys, "_s")
    if parts is not None:
        return _strengths_in_cells(edges, s, keys, parts)
    s1 = s.select(*keys, F.col("node").alias("node1"), F.col("_s").alias("_s1"))
    s2 = s.select(*keys, F.col("node").alias("node2"), F.col("_s").alias("_s2"))
    return edges.join(s1, [*keys, "node1"], "left").join(s2, [*keys, "node2"], "left")


def _strengths_in_cells(edges: DataFrame, s: DataFrame, keys: list[str], parts: int) -> DataFrame:
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    cell = lambda x, y: [F.least(x, y).alias("_p"), F.greatest(x, y).alias("_q")]
    tasks = max(parts * (parts + 1), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = s.dropna(subset=[*keys, "node"]).withColumn("_x", part("node")).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = sent.select(*keys, *cell(F.col("_x"), F.col("_y")), F.col("node").alias("node1"), F.col("node").alias("node2"), "_s")
    # a row with a strength stands for its node on both sides
    held = edges.select("*", *cell(part("node1"), part("node2"))).withColumn("_edge", F.lit(True))
    met = held.unionByName(sent, allowMissingColumns=True).repartition(tasks, *keys, *CELL)
    for c, out in (("node1", "_s1"), ("node2", "_s2")):
        met = met.withColumn(out, F.max("_s").over(Window.partitionBy(*keys, *CELL, c)))
    return met.filter("_edge").drop("_s", "_edge")


def proportional_weight(edges: DataFrame, by=None) -> DataFrame:
    """½(w/strength(node1) + w/strength(node2)), undefined -> 0 (#101)."""
    w = F.col("weight").cast("double")
    x = _with_strengths(edges, by)
    pw = F.lit(0.5) * (F.try_divide(w, F.col("_s1")) + F.try_divide(w, F.col("_s2")))
    return x.withColumn("proportional_weight", F.coalesce(pw, F.lit(0.0))).drop("_s1", "_s2")


def cii(edges: DataFrame, by=None, parts: int | None = None) -> DataFrame:
    """Collaboration intensity index w / (s1·s2 / Σw); 0 when undefined (#102). ``parts``: see ``_with_strengths``."""
    keys = _by(by)
    total = edges.groupBy(*keys).agg(F.sum("weight").cast("double").alias("_tot"))
    x = _with_strengths(edges, keys, parts).join(per_graph(total), keys)
    expected = F.try_divide(F.col("_s1").cast("double") * F.col("_s2"), F.col("_tot"))
    value = F.try_divide(F.col("weight").cast("double"), F.nullif(expected, F.lit(0.0)))
    return x.withColumn("cii", F.coalesce(value, F.lit(0.0))).drop("_s1", "_s2", "_tot")


def weight_metric_select(edges: DataFrame, metric: str, by=None) -> DataFrame:
    """Add ``computed_weight`` from 'raw' | 'proportion' | 'cii' (#30)."""
    if metric == "proportion":
        return proportional_weight(edges, by).withColumn("computed_weight", F.col("proportional_weight"))
    if metric == "cii":
        return cii(edges, by).withColumn("computed_weight", F.col("cii"))
    return edges.withColumn("computed_weight", F.col("weight").cast("double"))


def weight_threshold(edges: DataFrame, metric: str, t) -> DataFrame:
    """Keep edges with ``metric >= t`` (#20); on a stored column this reaches the parquet scan."""
    return edges.filter(F.col(metric) >= F.lit(t))


def edges_remaining(edges: DataFrame, thresholds: list, by=None) -> DataFrame:
    """Edges left per graph partition for each candidate threshold (#74), one scan."""
    keys = _by(by)
    return edges.groupBy(*keys).agg(
        *[F.count_if(F.col("weight") >= F.lit(t)).alias(f"edges_ge_{t}") for t in thresholds],
        F.count(F.lit(1)).alias("edges_total"),
    )


# ------------------------------------------------------- simple graph view


def undirected_simplify(edges: DataFrame, metric: str = "weight", by=None, how: str = "last", seq: str | None = None) -> DataFrame:
    """Undirected simple graph (#103).

    Repeated (u, v) / (v, u) rows collapse onto the canonical pair
    ``(least, greatest)``. ``how='last'`` keeps the metric of the last row in
    ``seq`` order (the reference's overwrite); ``how='sum'`` adds them.
    Output: ``by + (u, v, w)``.
    """
    keys = _by(by)
    u = F.least("node1", "node2").alias("u")
    v = F.greatest("node1", "node2").alias("v")
    base = edges.select(*keys, u, v, F.col(metric).alias("_w"), (F.col(seq) if seq else F.lit(0)).alias("_seq"))
    if how == "sum":
        return base.groupBy(*keys, "u", "v").agg(F.sum("_w").alias("w"))
    return base.groupBy(*keys, "u", "v").agg(F.max_by("_w", "_seq").alias("w"))


def incident_edges(edges: DataFrame, node: str, metric: str = "weight") -> DataFrame:
    """Edges touching ``node`` as (…, neighbour, metric); self-loops skipped (#23)."""
    hit = (F.col("node1") == F.lit(node)) | (F.col("node2") == F.lit(node))
    other = F.when(F.col("node1") == F.lit(node), F.col("node2")).otherwise(F.col("node1"))
    return (
        edges.filter(hit & (F.col("node1") != F.col("node2")))
        .withColumn("neighbour", other)
    )


def degree_centrality(simple: DataFrame, by=None) -> DataFrame:
    """degree / (n - 1) on the simple graph; a self-loop counts twice (#104)."""
    keys = _by(by)
    deg = (
        simple.select(*keys, F.explode(F.array("u", "v")).alias("node"))
        .groupBy(*keys, "node")
        .agg(F.count(F.lit(1)).alias("_deg"))
    )
    n = deg.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return deg.join(per_graph(n), keys).select(
        *keys,
        "node",
        F.coalesce(F.try_divide(F.col("_deg").cast("double"), F.col("_n") - 1), F.lit(1.0)).alias("degree"),
    )


def node_metric_strength(simple: DataFrame, by=None, out: str = "node_cii") -> DataFrame:
    """Sum of incident edge values in the simple graph (#105)."""
    keys = _by(by)
    return (
        simple.select(*keys, F.explode(F.array("u", "v")).alias("node"), "w")
        .groupBy(*keys, "node")
        .agg(F.sum("w").alias(out))
    )


def scale_to_range(nodes: DataFrame, col: str, lo: float, hi: float, const: float, by=None, out: str = "scaled") -> DataFrame:
    """lo + (hi-lo)·(c-min)/(max-min), ``const`` when max = min (#113)."""
    keys = _by(by)
    mm = nodes.groupBy(*keys).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    rng = F.col("_mx") - F.col("_mn")
    return nodes.join(per_graph(mm), keys).withColumn(
        out,
        F.when(rng != 0, F.lit(lo) + F.lit(hi - lo) * (F.col(col) - F.col("_mn")) / rng).otherwise(F.lit(const)),
    ).drop("_mn", "_mx")


def top_n_subgraph(edges: DataFrame, n: int, by=None) -> DataFrame:
    """Edges whose two ends are among the ``n`` strongest nodes of their graph (#109).

    Strongest = largest total weight, ties by node name. The ranking is a
    per-graph top-k (bounded output) and the filter two semi-joins.
    """
    keys = _by(by)
    from citegraph.operators.windows import topk_per_group

    s = node_strength(edges, "weight", keys)
    top = topk_per_group(s, keys, "strength", "node", n).select(*keys, "node")
    t1 = top.select(*keys, F.col("node").alias("node1"))
    t2 = top.select(*keys, F.col("node").alias("node2"))
    return edges.join(t1, [*keys, "node1"], "left_semi").join(t2, [*keys, "node2"], "left_semi")


def country_org_view(edges: DataFrame, mapping: DataFrame, dedup: bool = True, by=None) -> DataFrame:
    """Edges touching any organisation of each country (#110).

    ``mapping`` = (country_name, org). The reference concatenates one file per
    organisation, so an edge between two organisations of the same country
    appears twice (``dedup=False``); ``dedup=True`` keeps it once.
    Output: ``country_name`` + edge columns.
    """
    keys = _by(by)
    ends = edges.select(*keys, "node1", "node2", "weight", F.explode(F.array("node1", "node2")).alias("org"))
    if dedup:
        ends = ends.dropDuplicates([*keys, "node1", "node2", "org"])
    hit = ends.join(mapping.select("country_name", "org"), "org")
    if dedup:
        return hit.select("country_name", *keys, "node1", "node2", "weight").dropDuplicates(
            ["country_name", *keys, "node1", "node2"]
        )
    return hit.select("country_name", *keys, "node1", "node2", "weight")


def within_country_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Induced subgraph per country: both ends mapped to the same country (#111)."""
    m1 = mapping.select(F.col("org").alias("node1"), F.col("country_name"))
    m2 = mapping.select(F.col("org").alias("node2"), F.col("country_name"))
    return edges.join(m1, "node1").join(m2, ["node2", "country_name"])


def edge_metric_table(
    edges: DataFrame,
    node: str,
    metric: str,
    node_metric: DataFrame,
    node_metric_col: str,
    threshold,
    by=None,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """For one node: neighbour, edge metric, neighbour's node metric, the strongest edge first (#112).

    ``edges`` carries the metric column; it is thresholded, the neighbour's
    value is looked up in ``node_metric`` (``by + node``), 0 when absent.
    ``mapping`` (node, ...) adds its columns for the neighbour, such as an
    author's organisation and country; one row a node.
    """
    keys = _by(by)
    inc = incident_edges(weight_threshold(edges, metric, threshold), node, metric)
    nm = node_metric.select(*keys, F.col("node").alias("neighbour"), F.col(node_metric_col).alias("node_metric"))
    out, more = inc.join(nm, [*keys, "neighbour"], "left"), []
    if mapping is not None:
        more = [c for c in mapping.columns if c != "node"]
        out = out.join(mapping.withColumnRenamed("node", "neighbour"), "neighbour", "left")
    out = out.select(
        *keys,
        "neighbour",
        *more,
        F.col(metric).alias("edge_metric"),
        F.coalesce(F.col("node_metric"), F.lit(0.0)).cast("double").alias("node_metric"),
    )
    return out.orderBy(*keys, F.col("edge_metric").desc(), "neighbour")
