"""Catalog: impact scores, leaderboards, features, folds and the regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.operators import joins as J
from citegraph.operators import nested as N
from citegraph.operators import scoring as SC
from citegraph.plans import standins as S
from citegraph.plans.common import rounded
from citegraph.plans.registry import register, stage
from citegraph.session import cut_lineage, wide_shuffles
from citegraph.plans.relational_queries import (
    DSC_OK, GRC, PAC, PGC, PPC, PRED, _datasets_per_pub, _grants_per_pub, _patents_per_pub, _predictions, _pubs, _pw,
)
from citegraph.plans.sqlparts import AROWS, LINE, PWH, with_

COMPONENTS = ["field_citation_ratio", "altmetric_score", "Diff", "num_publications", "patent_count", "dataset_count", "grant_count", "num_unique_orgs"]


def _pub_level(spark, d):
    """Publication metrics + counts + residual (the scored publication table)."""
    pw = _pw(spark, d).select("publication_id", "field_citation_ratio", "altmetric_score", "num_unique_orgs", "authors")
    pw = J.residual_join(_predictions(spark, d), pw, "publication_id", "actual", "predicted")
    key = lambda df: df.withColumn("publication_id", F.col("publication_id").cast("string"))
    counts = J.multi_left_join(
        S.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("publication_id")),
        "publication_id",
        [
            (key(_datasets_per_pub(spark, d, False)), "dataset_count", 0),
            (key(_grants_per_pub(spark, d).withColumnRenamed("total_grant_count", "grant_count")), "grant_count", 0),
            (key(_patents_per_pub(spark, d).withColumnRenamed("total_patent_count", "patent_count")), "patent_count", 0),
        ],
    )
    return pw.join(counts, "publication_id")


def _author_level(spark, d):
    pubs = _pub_level(spark, d)
    rows = N.array_dedup_by_key(pubs, keep=[c for c in pubs.columns if c not in ("publication_id", "authors")])
    return rows.drop("author", "pos")


def _scored(spark, d):
    def build():
        with wide_shuffles(spark, S.table(spark, d, "lineitem").count()):
            return cut_lineage(SC.impact_score(_author_level(spark, d)))

    return stage(spark, d, "impact", build)


def _author_org(spark, d):
    oh = N.org_hierarchy_from_nested(_pubs(spark, d), S.grid(spark, d)).filter(F.col("author_id").isNotNull())
    return oh.select("author_name", F.col("organization_name").alias("highest_level_organization_name")).distinct()


PUBS = """pubs AS (SELECT p.publication_id, p.field_citation_ratio, p.altmetric_score, p.num_unique_orgs, pr.actual - pr.predicted AS Diff,
    COALESCE(dsk.dataset_count, 0) AS dataset_count, COALESCE(pgc.total_grant_count, 0) AS grant_count,
    COALESCE(ppc.total_patent_count, 0) AS patent_count
  FROM pwh p LEFT JOIN pred pr ON pr.publication_id = p.publication_id
  JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = p.publication_id
  LEFT JOIN dsk ON dsk.publication_id = o.o_orderkey LEFT JOIN pgc ON pgc.publication_id = o.o_orderkey
  LEFT JOIN ppc ON ppc.publication_id = o.o_orderkey),
al AS (SELECT a.publication_id, a.concatenated_name, pubs.* EXCLUDE (publication_id)
  FROM (SELECT DISTINCT publication_id, concatenated_name FROM arows) a JOIN pubs USING (publication_id)),
al2 AS (SELECT al.* EXCLUDE (Diff), COALESCE(GREATEST(Diff, 0), 0) AS Diff, np.num_publications FROM al
  JOIN (SELECT concatenated_name, COUNT(DISTINCT publication_id) AS num_publications FROM al GROUP BY 1) np USING (concatenated_name)),
al3 AS (SELECT publication_id, concatenated_name, """ + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in COMPONENTS) + """ FROM al2),
mm AS (SELECT """ + ", ".join(f"MIN({c}) AS mn_{c}, MAX({c}) AS mx_{c}" for c in COMPONENTS) + """ FROM al3),
sc AS (SELECT publication_id, concatenated_name, """ + " + ".join(
    f"{w} * ({c} - mn_{c}) / CASE WHEN mx_{c} <> mn_{c} THEN mx_{c} - mn_{c} ELSE 1 END"
    for c, w in SC.IMPACT_WEIGHTS.items()
) + """ AS impact_score FROM al3 CROSS JOIN mm)"""

SCORE_SQL = with_(LINE, PWH, AROWS, PRED, DSC_OK, GRC, PAC, PGC, PPC, PUBS)

ATO_N = """ato AS (SELECT DISTINCT split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS author_name, n_name AS highest_level_organization_name FROM line),
am AS (SELECT d.publication_id, d.concatenated_name, MIN(ato.highest_level_organization_name) AS highest_level_organization_name
  FROM (SELECT DISTINCT publication_id, concatenated_name FROM sc) d LEFT JOIN ato ON ato.author_name = d.concatenated_name GROUP BY 1, 2),
imp AS (SELECT am.*, sc.impact_score FROM am LEFT JOIN sc ON sc.publication_id = am.publication_id)"""


@register("impact_score", SCORE_SQL + "SELECT publication_id, concatenated_name, ROUND(impact_score, 6) AS impact_score FROM sc")
def impact_score(spark, d):
    return rounded(_scored(spark, d).select("publication_id", "concatenated_name", "impact_score"))


@register(
    "author_org_leaderboard",
    SCORE_SQL
    + ", "
    + ATO_N
    + """
SELECT concatenated_name, ROUND(SUM(impact_score), 6) AS total_impact_score, ROUND(MEDIAN(impact_score), 6) AS median_impact_score
FROM imp GROUP BY 1 ORDER BY SUM(impact_score) DESC, concatenated_name LIMIT 30""",
)
def author_org_leaderboard(spark, d):
    """Top 30 authors by total impact (faithful publication-only join)."""
    return rounded(SC.author_leaderboard(_scored(spark, d), _author_org(spark, d), 30))


@register(
    "organization_leaderboard",
    SCORE_SQL
    + ", "
    + ATO_N
    + """
SELECT highest_level_organization_name, ROUND(SUM(impact_score), 6) AS total_impact_score, COUNT(DISTINCT concatenated_name) AS num_authors,
  ROUND(SUM(impact_score) / COUNT(DISTINCT concatenated_name), 6) AS average_impact_per_author
FROM imp GROUP BY 1 ORDER BY SUM(impact_score) DESC, highest_level_organization_name LIMIT 30""",
)
def organization_leaderboard(spark, d):
    """Top 30 organisations by total impact, authors and impact per author."""
    return rounded(SC.organization_leaderboard(_scored(spark, d), _author_org(spark, d), 30))


@register(
    "sum_and_median",
    SCORE_SQL + ", " + ATO_N + """
SELECT concatenated_name, ROUND(SUM(impact_score), 6) AS total_impact_score, ROUND(MEDIAN(impact_score), 6) AS median_impact_score FROM imp GROUP BY 1""",
)
def sum_and_median(spark, d):
    from citegraph.operators.aggregates import sum_and_median as sm

    sc = _scored(spark, d)
    metrics = sc.select("publication_id", "concatenated_name").distinct()
    imp = J.fanout_join(metrics, sc, "publication_id", "concatenated_name")
    return rounded(sm(imp, "concatenated_name", "impact_score"))


_NORMALISED = ", ".join(f"ROUND(AVG(normalized_{c}), 6) AS normalized_{c}" for c in COMPONENTS)


@register(
    "mean_components",
    SCORE_SQL + ", " + ATO_N
    + """, n AS (SELECT publication_id, concatenated_name, """
    + ", ".join(f"({c} - mn_{c}) / CASE WHEN mx_{c} <> mn_{c} THEN mx_{c} - mn_{c} ELSE 1 END AS normalized_{c}" for c in COMPONENTS)
    + f""" FROM al3 CROSS JOIN mm)
SELECT 'author' AS level, concatenated_name AS name, {_NORMALISED} FROM n GROUP BY 2
UNION ALL SELECT 'organization', highest_level_organization_name, {_NORMALISED} FROM n JOIN am USING (publication_id, concatenated_name) GROUP BY 2""",
)
def mean_components(spark, d):
    """Mean normalised components per author and per organisation, from the author-level rows."""
    from citegraph.operators.aggregates import mean_components as mc

    sc, cols = _scored(spark, d), [f"normalized_{c}" for c in COMPONENTS]
    metrics, _, _ = SC._leaderboard_rows(sc.select("publication_id", "concatenated_name", "impact_score"), _author_org(spark, d), False)
    level = lambda rows, key, name: mc(rows, key, cols).select(F.lit(name).alias("level"), F.col(key).alias("name"), *cols)
    orgs = sc.join(metrics, ["publication_id", "concatenated_name"])
    return rounded(level(sc, "concatenated_name", "author").union(level(orgs, "highest_level_organization_name", "organization")))


@register(
    "ratio_of_aggregates",
    SCORE_SQL + ", " + ATO_N + """
SELECT highest_level_organization_name, ROUND(SUM(impact_score), 6) AS total_impact_score, COUNT(DISTINCT concatenated_name) AS num_authors,
  ROUND(SUM(impact_score) / COUNT(DISTINCT concatenated_name), 6) AS average_impact_per_author FROM imp GROUP BY 1""",
)
def ratio_of_aggregates(spark, d):
    from citegraph.operators.aggregates import ratio_of_aggregates as ra

    sc = _scored(spark, d)
    metrics = sc.select("publication_id", "concatenated_name").distinct().join(
        _author_org(spark, d).withColumnRenamed("author_name", "concatenated_name"), "concatenated_name", "left"
    ).groupBy("publication_id", "concatenated_name").agg(F.min("highest_level_organization_name").alias("highest_level_organization_name"))
    imp = J.fanout_join(metrics, sc, "publication_id", "concatenated_name")
    return rounded(ra(imp, "highest_level_organization_name", "impact_score", "concatenated_name"))


@register(
    "residual",
    with_(LINE, PWH, PRED) + "SELECT publication_id, ROUND(actual - predicted, 6) AS Diff FROM pred",
)
def residual(spark, d):
    return rounded(SC.residual(_predictions(spark, d), "actual", "predicted").select("publication_id", "Diff"))


# ---------------------------------------------------------------- features

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register(
    "one_hot_drop_first",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderpriority = '{p}' AS INTEGER) AS \"o_orderpriority_{p}\"" for p in PRIORITIES[1:])
    + " FROM orders",
)
def one_hot_drop_first(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return SC.one_hot_drop_first(o, "o_orderpriority")


@register(
    "date_parse_coerce",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders",
)
def date_parse_coerce(spark, d):
    o = S.table(spark, d, "orders")
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return SC.date_parse_coerce(o.select("o_orderkey", txt.alias("d")), ["d"])


FEAT = """ft AS (SELECT publication_id, year, CAST(date AS DATE) AS date, citation_count, times_cited, recent_citations,
  COALESCE(field_citation_ratio, 0.0) AS field_citation_ratio, COALESCE(relative_citation_ratio, 0.0) AS relative_citation_ratio,
  altmetric_score, CAST(is_open_access AS INTEGER) AS is_open_access, num_unique_orgs, n_authors AS num_authors,
  CAST(len(string_split(clinical_trial_ids, ',')) AS BIGINT) AS num_clinical_trial_ids,
  CAST(len(list_distinct(string_split(research_org_city_ids, ','))) AS BIGINT) AS num_unique_city_ids,
  CAST(len(list_distinct(string_split(research_org_country_codes, ','))) AS BIGINT) AS num_unique_country_codes,
  CAST(len(list_distinct(string_split(research_org_state_codes, ','))) AS BIGINT) AS num_unique_state_codes, """ + ", ".join(
    f"CAST(publication_type = '{p}' AS INTEGER) AS \"publication_type_{p}\"" for p in PRIORITIES[1:]
) + ", " + ", ".join(
    f"CAST(left(publication_type, 1) = '{p[0]}' AS INTEGER) AS \"research_org_state_codes_{p[0]}\"" for p in PRIORITIES[1:]
) + """ FROM pwh WHERE altmetric_score IS NOT NULL)"""


def _features(spark, d):
    # the stand-ins have no states: the first letter of the publication type plays the state code
    pw = _pw(spark, d).withColumn("research_org_state_codes", F.substring("publication_type", 1, 1))
    x = SC.feature_table(pw).drop("authors")
    for c in ["num_authors", "num_clinical_trial_ids", "num_unique_city_ids", "num_unique_country_codes", "num_unique_state_codes"]:
        x = x.withColumn(c, F.col(c).cast("bigint"))
    return x


@register("feature_table", with_(LINE, PWH, FEAT) + "SELECT * FROM ft")
def feature_table(spark, d):
    return rounded(_features(spark, d))


@register(
    "standard_scale",
    with_(LINE, PWH, FEAT)
    + """, st AS (SELECT AVG(times_cited) AS mt, STDDEV_POP(times_cited) AS st, AVG(citation_count) AS mc, STDDEV_POP(citation_count) AS sc
  FROM ft WHERE year < 2000)
SELECT publication_id, ROUND((times_cited - mt) / CASE WHEN st > 0 THEN st ELSE 1 END, 6) AS times_cited_z,
  ROUND((citation_count - mc) / CASE WHEN sc > 0 THEN sc ELSE 1 END, 6) AS citation_count_z FROM ft CROSS JOIN st WHERE year >= 2000""",
)
def standard_scale(spark, d):
    f = _features(spark, d)
    _, test, _ = SC.standard_scale(f.filter(F.col("year") < 2000), f.filter(F.col("year") >= 2000), ["times_cited", "citation_count"])
    return rounded(test.select("publication_id", "times_cited_z", "citation_count_z"))


@register(
    "forward_chain_folds",
    with_(LINE, PWH, FEAT)
    + """, rn AS (SELECT publication_id, ROW_NUMBER() OVER (ORDER BY date, publication_id) AS r, COUNT(*) OVER () AS n FROM ft)
, b AS (SELECT publication_id, CAST(CASE WHEN r <= n - 4 * (n // 5) THEN 0 ELSE (r - (n - 4 * (n // 5)) - 1) // (n // 5) + 1 END AS INTEGER) AS block FROM rn)
SELECT publication_id, block, CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold THEN 'test' ELSE 'train' END AS role
FROM b JOIN (SELECT unnest(range(1, 5)) AS fold) ON block <= fold""",
)
def forward_chain_folds(spark, d):
    """Every fold's rows with their role: earlier blocks train, the fold's own block is the test."""
    f = _features(spark, d).select("publication_id", "date")
    return SC.forward_chain_folds(f, ["date", "publication_id"], 4).select("publication_id", "block", "fold", "role")


GROUPS = """grp AS (SELECT p.publication_id, COALESCE(g.grp, '') AS author_group FROM pwh p LEFT JOIN
 (SELECT CAST(l_orderkey AS VARCHAR) AS publication_id,
         string_agg(CAST(n_nationkey AS VARCHAR), '_' ORDER BY l_linenumber, l_partkey, CAST(l_suppkey AS VARCHAR)) AS grp
  FROM line GROUP BY l_orderkey) g ON g.publication_id = p.publication_id)"""


@register(
    "group_folds",
    with_(LINE, PWH, GROUPS)
    + """, sz AS (SELECT author_group, COUNT(*) AS size FROM grp GROUP BY 1),
rk AS (SELECT author_group, (ROW_NUMBER() OVER (ORDER BY size DESC, author_group) - 1) % 6 AS pos FROM sz)
SELECT grp.publication_id, grp.author_group, CAST(CASE WHEN pos < 3 THEN pos ELSE 5 - pos END AS INTEGER) AS fold
FROM grp JOIN rk USING (author_group)""",
)
def group_folds(spark, d):
    g = N.author_group_key(_pw(spark, d)).select("publication_id", "author_group")
    return SC.group_folds(g, "author_group", 3)


@register(
    "anti_join_group_leakage",
    with_(LINE, PWH, GROUPS)
    + "SELECT a.publication_id FROM grp a JOIN pwh p USING (publication_id) WHERE p.year < 2000 "
    "AND a.author_group NOT IN (SELECT g.author_group FROM grp g JOIN pwh q USING (publication_id) WHERE q.year >= 2000)",
)
def anti_join_group_leakage(spark, d):
    """Training publications (before 2000) whose author group also occurs in the test years are removed."""
    g = N.author_group_key(_pw(spark, d)).select("publication_id", "year", "author_group")
    out = J.anti_join_leakage(g.filter(F.col("year") < 2000), g.filter(F.col("year") >= 2000), "author_group")
    return out.select("publication_id")


# ------------------------------------------------------------- regression

FEATURES = ["citation_count", "times_cited", "recent_citations", "field_citation_ratio", "relative_citation_ratio", "num_unique_orgs", "num_authors"]
#: draws of the search and trees of its rungs. The reference draws 80 from 50-5000 trees; here trees are bounded, depth too
DRAWS, RUNGS, MAX_TREES = 10, (2, 5, 10), 10


def _space():
    return [{**p, "maxDepth": 3 + p["maxDepth"] % 4} for p in SC.draw_params(DRAWS)]


@register("gbt_regression")
def gbt_regression(spark, d):
    """Gradient-boosted trees on publications before 2000, predictions for the later ones."""
    f = _features(spark, d)
    model = SC.gbt_regression(f.filter(F.col("year") < 2000), FEATURES, "altmetric_score", {"maxIter": 10, "maxDepth": 4})
    pred = SC.gbt_predict(model, f.filter(F.col("year") >= 2000), FEATURES)
    return rounded(pred.select("publication_id", "altmetric_score", F.col("prediction").alias("predicted")))


@register("gbt_error")
def gbt_error(spark, d):
    """Error of the trees' predictions for later publications against that of the training mean."""
    f = cut_lineage(_features(spark, d))
    train, test = f.filter(F.col("year") < 2000), f.filter(F.col("year") >= 2000)
    model = SC.gbt_regression(train, FEATURES, "altmetric_score", {"maxIter": 10, "maxDepth": 4})
    mean = train.agg(F.avg("altmetric_score")).first()[0]
    y = F.col("altmetric_score")
    rmse = lambda p: F.sqrt(F.avg((p - y) ** 2))
    out = SC.gbt_predict(model, test, FEATURES).agg(F.count(F.lit(1)).alias("n"), rmse(F.col("prediction")).alias("rmse"), rmse(F.lit(mean)).alias("rmse_of_mean"))
    return rounded(out.withColumn("better", F.col("rmse") < F.col("rmse_of_mean")))


@register("hyperparameter_search")
def hyperparameter_search(spark, d):
    """Successive halving over ten parameter draws with author-group folds; one row per candidate and rung."""
    f = _features(spark, d)
    g = N.author_group_key(_pw(spark, d)).select("publication_id", "author_group")
    tr = SC.group_folds(f.join(g, "publication_id"), "author_group", 3, "_fold")
    _, _, rows = SC.hyperparameter_search(tr, FEATURES, "altmetric_score", "_fold", _space(), RUNGS, max_trees=MAX_TREES)
    return spark.createDataFrame(rows, "candidate INT, rung INT, trees INT, mse DOUBLE")


@register("nested_cv_predict")
def nested_cv_predict(spark, d):
    """Outer forward-chaining folds, leakage filter, scaling, inner group-fold search over ten draws, predictions."""
    f = _features(spark, d)
    g = N.author_group_key(_pw(spark, d)).select("publication_id", "author_group")
    x = f.join(g, "publication_id")
    res = SC.nested_cv_predict(
        x, FEATURES, "altmetric_score", "publication_id", ["date", "publication_id"], "author_group",
        n_outer=4, n_inner=3, space=_space(), rungs=(1, 4), max_trees=MAX_TREES,
    )
    return rounded(res)
