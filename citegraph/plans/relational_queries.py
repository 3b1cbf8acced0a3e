"""Catalog: scans, projections, nested data, joins, aggregates, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.functions import columns as C
from citegraph.functions.themes import theme_dimension, theme_values_sql
from citegraph.operators import aggregates as A
from citegraph.operators import joins as J
from citegraph.operators import nested as N
from citegraph.operators import ordering as O
from citegraph.operators import windows as Wn
from citegraph.operators import graph as G
from citegraph.plans import standins as S
from citegraph.plans.common import rounded
from citegraph.plans.graph_queries import edges
from citegraph.plans.registry import register, stage
from citegraph.session import cut_lineage, wide_shuffles
from citegraph.plans.sqlparts import AROWS, LINE, OH, PWH, edges_sql, with_

PW_SCALARS = [
    "publication_id", "year", "date", "publication_type", "clinical_trial_ids", "citation_count", "times_cited",
    "recent_citations", "field_citation_ratio", "relative_citation_ratio", "altmetric_score", "is_open_access",
    "unique_org_ids", "research_org_city_ids", "research_org_country_codes", "research_org_state_codes",
    "num_unique_orgs",
]


def _pubs(spark, d):
    """Nested publication stand-in, built once per session."""

    def build():
        with wide_shuffles(spark, S.table(spark, d, "lineitem").count()):
            return cut_lineage(S.publications(spark, d))

    return stage(spark, d, "publications", build)


def _pw(spark, d):
    """pubWhole, flattened once per session and checkpointed (several queries read it more than once)."""
    return stage(spark, d, "pub_whole", lambda: cut_lineage(N.pub_whole(_pubs(spark, d))))


def _arows(spark, d):
    """Author rows of the nested publications (pos = position in the author list)."""
    return N.author_rows(_pw(spark, d)).select(
        "publication_id", "pos", F.col("author.researcher_id").alias("researcher_id"), "concatenated_name"
    )


# ------------------------------------------------------------ nested (2.3)


@register(
    "unnest_outer_chain",
    with_(LINE, PWH) + "SELECT * FROM pwh",
)
def unnest_outer_chain(spark, d):
    """pubWhole: scalars, distinct lists, org counts; struct arrays reported by length."""
    pw = _pw(spark, d)
    return rounded(
        pw.select(
            *PW_SCALARS,
            F.size("authors").cast("bigint").alias("n_authors"),
            F.size("funding_details").cast("bigint").alias("n_funding"),
        )
    )


@register(
    "struct_project",
    with_(LINE, PWH) + "SELECT publication_id AS id, times_cited, ROUND(altmetric_score, 6) AS altmetric_score, ROUND(field_citation_ratio, 6) AS fcr FROM pwh",
)
def struct_project(spark, d):
    p = S.publications(spark, d)
    return rounded(
        N.struct_project(
            p, {"id": "id", "times_cited": "metrics.times_cited", "altmetric_score": "altmetrics.score", "fcr": "metrics.field_citation_ratio"}
        )
    )


@register(
    "cast_project",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders",
)
def cast_project(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return N.cast_project(o, {"o_orderkey": "string", "o_custkey": "double"})


@register(
    "numeric_coerce",
    "SELECT o_orderkey, COALESCE(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE), 0.0) AS priority_num, "
    "COALESCE(TRY_CAST(o_orderstatus AS DOUBLE), 0.0) AS status_num FROM orders",
)
def numeric_coerce(spark, d):
    o = S.table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        C.numeric_or(F.split("o_orderpriority", "-")[0]).alias("priority_num"),
        C.numeric_or("o_orderstatus").alias("status_num"),
    )


@register(
    "flag_nonempty_array",
    with_(LINE, PWH) + "SELECT publication_id AS id, clinical_trial_ids <> '' AS has_trials FROM pwh",
)
def flag_nonempty_array(spark, d):
    p = S.publications(spark, d)
    return p.select("id", C.nonempty_flag("clinical_trial_ids").alias("has_trials"))


@register(
    "not_null_filter",
    with_(LINE) + "SELECT CAST(l_orderkey AS VARCHAR) AS publication_id, CAST(l_suppkey AS VARCHAR) AS researcher_id FROM line WHERE l_suppkey IS NOT NULL",
)
def not_null_filter(spark, d):
    p = S.publications(spark, d)
    return N.unnest_inner(p, "id", "authors", {"researcher_id": "researcher_id"}, not_null="researcher_id").withColumnRenamed(
        "id", "publication_id"
    )


@register(
    "unnest_inner",
    with_(LINE) + "SELECT CAST(l_orderkey AS VARCHAR) AS publication_id, CAST(l_suppkey AS VARCHAR) AS researcher_id, "
    "split_part(s_name, '#', 1) AS first_name FROM line",
)
def unnest_inner(spark, d):
    p = S.publications(spark, d)
    return N.unnest_inner(p, "id", "authors", {"researcher_id": "researcher_id", "first_name": "first_name"}).withColumnRenamed(
        "id", "publication_id"
    )


@register(
    "collect_structs",
    with_(LINE) + "SELECT publication_id, string_agg(a, ';' ORDER BY rid, s_name) AS authors FROM (SELECT DISTINCT l_orderkey AS publication_id, "
    "CAST(l_suppkey AS VARCHAR) AS rid, s_name, CAST(l_suppkey AS VARCHAR) || ':' || s_name AS a FROM line) x GROUP BY publication_id",
)
def collect_structs(spark, d):
    li = S.table(spark, d, "lineitem")
    s = S.table(spark, d, "supplier")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("l_orderkey").alias("publication_id"), F.col("l_suppkey").cast("string").alias("rid"), F.col("s_name")
    ).distinct()
    c = N.collect_structs(rows, "publication_id", ["rid", "s_name"], "authors")
    return c.select("publication_id", F.array_join(F.transform("authors", lambda a: F.concat_ws(":", a["rid"], a["s_name"])), ";").alias("authors"))


@register(
    "distinct_list_string",
    with_(OH) + "SELECT publication_id, array_to_string(list_sort(list_distinct(list(organization_name))), ', ') AS organizations FROM oh GROUP BY publication_id",
)
def distinct_list_string(spark, d):
    """Every publication's organisations as one string, as the reference collects them."""
    return N.distinct_list_string(S.org_hierarchy(spark, d), "publication_id", "organization_name", "organizations")


@register(
    "array_to_string",
    with_(LINE) + "SELECT CAST(o.o_orderkey AS VARCHAR) AS id, COALESCE(g.s, '') AS trials FROM orders o LEFT JOIN "
    "(SELECT l_orderkey, array_to_string(list_sort(list(l_returnflag)), ', ') AS s FROM line GROUP BY l_orderkey) g ON g.l_orderkey = o.o_orderkey",
)
def array_to_string(spark, d):
    p = S.publications(spark, d)
    return N.array_to_string(p, "clinical_trial_ids", "trials").select("id", "trials")


@register(
    "first_matching_element",
    with_(OH) + "SELECT DISTINCT publication_id || '' AS publication_id, publication_year, CAST(author_id AS VARCHAR) AS author_id, "
    "split_part(author_name, '#', 1) || ' ' || split_part(author_name, '#', 2) AS author_name, CAST(org_id AS VARCHAR) AS org_grid_id, "
    "country_name, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, organization_name, "
    "'region.' || CAST(high_level_org_id AS VARCHAR) AS high_level_org_id, high_level_org_name, "
    "CAST(NULL AS VARCHAR) AS low_level_org_id, CAST(NULL AS VARCHAR) AS low_level_org_name FROM oh "
    "UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(year(o_orderdate) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL "
    "FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def first_matching_element(spark, d):
    """org_hierarchy from nested publications x grid: first 'Parent' relationship, else the org itself."""
    return N.org_hierarchy_from_nested(S.publications(spark, d), S.grid(spark, d))


@register(
    "affiliation_parent_join",
    with_(OH) + "SELECT author_id, COUNT(DISTINCT high_level_org_name) AS n_parents, MIN(high_level_org_name) AS parent FROM oh GROUP BY author_id",
)
def affiliation_parent_join(spark, d):
    oh = N.org_hierarchy_from_nested(S.publications(spark, d), S.grid(spark, d)).filter(F.col("author_id").isNotNull())
    return oh.groupBy(F.col("author_id").cast("bigint").alias("author_id")).agg(
        F.countDistinct("high_level_org_name").alias("n_parents"), F.min("high_level_org_name").alias("parent")
    )


@register(
    "array_dedup_by_key",
    with_(LINE, AROWS) + "SELECT publication_id, concatenated_name, MIN(pos) AS pos FROM arows GROUP BY publication_id, concatenated_name",
)
def array_dedup_by_key(spark, d):
    return N.array_dedup_by_key(_pw(spark, d)).select("publication_id", "concatenated_name", "pos")


@register(
    "array_map_names",
    with_(LINE, AROWS) + "SELECT publication_id, string_agg(concatenated_name, ', ' ORDER BY pos) AS author_names FROM arows GROUP BY publication_id",
)
def array_map_names(spark, d):
    pw = _pw(spark, d).filter(F.size("authors") > 0)
    return N.array_map_names(pw).select("publication_id", "author_names")


@register(
    "explode_to_author_rows",
    with_(LINE, AROWS) + "SELECT publication_id, pos, researcher_id, concatenated_name FROM arows",
)
def explode_to_author_rows(spark, d):
    return _arows(spark, d)


@register(
    "author_group_key",
    with_(LINE, PWH)
    + """SELECT p.publication_id, COALESCE(g.grp, '') AS author_group FROM pwh p LEFT JOIN
 (SELECT CAST(l_orderkey AS VARCHAR) AS publication_id,
         string_agg(CAST(n_nationkey AS VARCHAR), '_' ORDER BY l_linenumber, l_partkey, CAST(l_suppkey AS VARCHAR)) AS grp
  FROM line GROUP BY l_orderkey) g ON g.publication_id = p.publication_id""",
)
def author_group_key(spark, d):
    return N.author_group_key(_pw(spark, d)).select("publication_id", "author_group")


@register(
    "token_count",
    with_(LINE, PWH)
    + "SELECT publication_id, CASE WHEN clinical_trial_ids IS NULL THEN 0 ELSE len(string_split(clinical_trial_ids, ',')) END AS num_clinical_trial_ids, "
    "CASE WHEN unique_org_ids IS NULL THEN 0 ELSE len(list_distinct(string_split(unique_org_ids, ','))) END AS num_unique_org_ids, "
    "n_authors AS num_authors FROM pwh",
)
def token_count(spark, d):
    pw = _pw(spark, d)
    return pw.select(
        "publication_id",
        C.token_count("clinical_trial_ids").cast("bigint").alias("num_clinical_trial_ids"),
        C.token_distinct_count("unique_org_ids").cast("bigint").alias("num_unique_org_ids"),
        F.size("authors").cast("bigint").alias("num_authors"),
    )


# --------------------------------------------------------- projections (2.2)


@register(
    "in_list_filter",
    with_(OH, edges_sql("org"))
    + "SELECT * FROM e WHERE node1 IN (SELECT organization_name FROM oh WHERE country_name = 'ASIA') "
    "AND node2 IN (SELECT organization_name FROM oh WHERE country_name = 'ASIA')",
)
def in_list_filter(spark, d):
    e = edges(spark, d, "org")
    vals = S.org_hierarchy(spark, d).filter(F.col("country_name") == "ASIA").select(F.col("organization_name").alias("v"))
    return e.join(vals.withColumnRenamed("v", "node1"), "node1", "left_semi").join(
        vals.withColumnRenamed("v", "node2"), "node2", "left_semi"
    )


@register("year_filter", with_(OH, edges_sql("org")) + "SELECT * FROM e WHERE year BETWEEN 1997 AND 1999")
def year_filter(spark, d):
    e = edges(spark, d, "org")
    return e.filter(F.col("year").between(1997, 1999))


@register(
    "drop_columns_if_present",
    with_(LINE, PWH) + "SELECT publication_id, year, publication_type, times_cited FROM pwh",
)
def drop_columns_if_present(spark, d):
    pw = _pw(spark, d).select("publication_id", "year", "publication_type", "times_cited", "authors", "date")
    return pw.drop("authors", "date", "title_preferred", "conference_name")


@register(
    "fill_nulls",
    with_(LINE, PWH)
    + "SELECT publication_id, COALESCE(times_cited, 0) AS times_cited, ROUND(COALESCE(field_citation_ratio, 0.0), 6) AS field_citation_ratio FROM pwh",
)
def fill_nulls(spark, d):
    pw = _pw(spark, d).select("publication_id", "times_cited", "field_citation_ratio")
    return rounded(pw.fillna({"times_cited": 0, "field_citation_ratio": 0.0}))


@register(
    "code_to_name",
    "SELECT d.doc_id, th.cluster_number, th.cluster_name FROM documents d JOIN "
    + theme_values_sql()
    + " ON th.cluster_number = CAST(substr(d.source, 4) AS INTEGER) + 1",
)
def code_to_name(spark, d):
    docs = S.table(spark, d, "documents").select(
        "doc_id", (F.substring("source", 4, 10).cast("int") + 1).alias("cluster_number")
    )
    dim = theme_dimension(spark).select("cluster_number", "cluster_name")
    return docs.join(F.broadcast(dim), "cluster_number")


@register(
    "clip_negative",
    "SELECT c_custkey, ROUND(COALESCE(GREATEST(c_acctbal, 0), 0), 6) AS acctbal FROM customer",
)
def clip_negative(spark, d):
    c = S.table(spark, d, "customer")
    return rounded(c.select("c_custkey", C.clip_negative("c_acctbal").cast("double").alias("acctbal")))


@register(
    "sanitise_name",
    """SELECT p_partkey, regexp_replace(p_brand, '[<>:"/\\\\|?*]', '_', 'g') AS file_name,
  array_to_string(list_transform(string_split(lower(regexp_replace(p_name || ' ' || p_type, '[\\s''"()]', '_', 'g')), ''),
    lambda ch, i: CASE WHEN i = 1 OR NOT regexp_matches(string_split(lower(regexp_replace(p_name || ' ' || p_type, '[\\s''"()]', '_', 'g')), '')[i - 1], '^\\p{L}$')
                    THEN upper(ch) ELSE ch END), '') AS title
FROM part""",
)
def sanitise_name(spark, d):
    p = S.table(spark, d, "part")
    return p.select(
        "p_partkey",
        C.sanitise_name("p_brand", "file").alias("file_name"),
        C.sanitise_name(F.concat_ws(" ", "p_name", "p_type"), "title").alias("title"),
    )


@register(
    "valid_point_filter",
    """SELECT id, ROUND(pt[1], 6) AS x, ROUND(pt[2], 6) AS y FROM (
  SELECT vec_id AS id, CAST(json(CASE WHEN label = 0 THEN '[' || vec_id || ']' WHEN label = 1 THEN '[' || vec_id || ', null]'
         ELSE '[' || vec_id || ', ' || label || ']' END) AS DOUBLE[]) AS pt FROM embeddings) t
WHERE len(pt) = 2 AND pt[1] IS NOT NULL AND pt[2] IS NOT NULL""",
)
def valid_point_filter(spark, d):
    e = S.table(spark, d, "embeddings")
    txt = (
        F.when(F.col("label") == 0, F.concat(F.lit("["), F.col("vec_id"), F.lit("]")))
        .when(F.col("label") == 1, F.concat(F.lit("["), F.col("vec_id"), F.lit(", null]")))
        .otherwise(F.concat(F.lit("["), F.col("vec_id"), F.lit(", "), F.col("label"), F.lit("]")))
    )
    pts = N.valid_points(e.select(F.col("vec_id").alias("id"), txt.alias("pos_text")), "pos_text")
    return rounded(pts.select("id", "x", "y"))


# ------------------------------------------------------------------ joins (2.4)

DSC = """dsc AS (SELECT o.o_orderkey AS publication_id, COUNT(*) AS dataset_count FROM orders o
  LEFT JOIN lineitem ds ON ds.l_orderkey = o.o_orderkey AND ds.l_returnflag = 'R' GROUP BY o.o_orderkey)"""
DSC_OK = """dsk AS (SELECT o.o_orderkey AS publication_id, COUNT(ds.l_orderkey) AS dataset_count FROM orders o
  LEFT JOIN lineitem ds ON ds.l_orderkey = o.o_orderkey AND ds.l_returnflag = 'R' GROUP BY o.o_orderkey)"""
GRC = """grc AS (SELECT l_suppkey AS researcher_id, COUNT(*) AS grant_count FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey)"""
PAC = """pac AS (SELECT l_suppkey AS researcher_id, COUNT(DISTINCT l_partkey) AS patent_count FROM lineitem GROUP BY l_suppkey)"""
PGC = """pgc AS (SELECT pa.l_orderkey AS publication_id, CAST(SUM(g.grant_count) AS BIGINT) AS total_grant_count
  FROM lineitem pa LEFT JOIN grc g ON g.researcher_id = pa.l_suppkey GROUP BY pa.l_orderkey)"""
PPC = """ppc AS (SELECT pa.l_orderkey AS publication_id, CAST(SUM(g.patent_count) AS BIGINT) AS total_patent_count
  FROM lineitem pa LEFT JOIN pac g ON g.researcher_id = pa.l_suppkey GROUP BY pa.l_orderkey)"""


def _datasets_per_pub(spark, d, faithful):
    pubs = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("publication_id"))
    return J.left_join_count(pubs, S.datasets(spark, d), "publication_id", "associated_publication_id", "dataset_count", faithful)


def _grants_per_pub(spark, d):
    act = S.researcher_activity(spark, d)
    grc = act.filter(F.col("l_returnflag") == "A").groupBy("researcher_id").agg(F.count(F.lit(1)).alias("grant_count"))
    pa = S.publication_authors(spark, d)
    return J.left_join_sum(pa, grc, "publication_id", "researcher_id", "grant_count", "total_grant_count")


def _patents_per_pub(spark, d):
    act = S.researcher_activity(spark, d)
    pac = A.count_distinct_group(act, "researcher_id", "l_partkey", "patent_count")
    pa = S.publication_authors(spark, d)
    return J.left_join_sum(pa, pac, "publication_id", "researcher_id", "patent_count", "total_patent_count")


@register("count_per_key", with_(DSC) + "SELECT * FROM dsc")
def count_per_key(spark, d):
    """COUNT(*) after LEFT JOIN, faithful: a publication without datasets counts 1."""
    return _datasets_per_pub(spark, d, faithful=True)


@register("left_join_counts", with_(DSC_OK) + "SELECT * FROM dsk")
def left_join_counts(spark, d):
    """Corrected count: matched dataset rows, 0 when none."""
    return _datasets_per_pub(spark, d, faithful=False)


@register("sum_per_key", with_(GRC, PGC) + "SELECT * FROM pgc")
def sum_per_key(spark, d):
    return _grants_per_pub(spark, d)


@register(
    "filter_to_known",
    with_(DSC) + "SELECT publication_id, dataset_count FROM dsc WHERE publication_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')",
)
def filter_to_known(spark, d):
    counts = _datasets_per_pub(spark, d, faithful=True)
    known = S.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "N").select(F.col("l_orderkey").alias("publication_id"))
    return J.filter_to_known(counts, known, "publication_id")


@register(
    "multi_left_join",
    with_(DSC_OK, GRC, PAC, PGC, PPC)
    + """SELECT o.o_orderkey AS publication_id, COALESCE(dsk.dataset_count, 0) AS dataset_count,
  COALESCE(pgc.total_grant_count, 0) AS total_grant_count, COALESCE(ppc.total_patent_count, 0) AS total_patent_count
FROM orders o LEFT JOIN dsk ON dsk.publication_id = o.o_orderkey LEFT JOIN pgc ON pgc.publication_id = o.o_orderkey
LEFT JOIN ppc ON ppc.publication_id = o.o_orderkey""",
)
def multi_left_join(spark, d):
    base = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("publication_id"))
    return J.multi_left_join(
        base,
        "publication_id",
        [
            (_datasets_per_pub(spark, d, False), "dataset_count", 0),
            (_grants_per_pub(spark, d), "total_grant_count", 0),
            (_patents_per_pub(spark, d), "total_patent_count", 0),
        ],
    )


@register(
    "order_reconcile",
    """WITH a AS (SELECT o_orderkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS rn FROM orders),
b AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) x)
SELECT a.id AS a_id, a.rn AS a_row_num, b.id AS b_id, b.rn AS b_row_num
FROM a FULL OUTER JOIN b ON a.rn = b.rn WHERE a.id IS DISTINCT FROM b.id""",
)
def order_reconcile(spark, d):
    a = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    b = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return J.order_reconcile(a, b, "id")


ATO = """ato AS (SELECT DISTINCT author_id, author_name, country_name, organization_name AS highest_level_organization_name FROM oh)"""


def _author_to_org(spark, d):
    oh = S.org_hierarchy(spark, d)
    return A.distinct_rows(
        oh.select("author_id", "author_name", "country_name", F.col("organization_name").alias("highest_level_organization_name")),
        ["author_id", "author_name", "country_name", "highest_level_organization_name"],
    )


@register("distinct_rows", with_(OH, ATO) + "SELECT * FROM ato")
def distinct_rows(spark, d):
    return _author_to_org(spark, d)


@register(
    "dim_lookup",
    with_(OH, ATO)
    + """SELECT c.c_custkey, c.c_name, COALESCE(a.highest_level_organization_name, 'Unknown Organization') AS highest_level_organization_name,
  COALESCE(a.country_name, 'Unknown Country') AS country_name
FROM customer c LEFT JOIN ato a ON a.author_id = c.c_custkey""",
)
def dim_lookup(spark, d):
    """Customers looked up in the author -> organisation mapping by id; misses get defaults."""
    cust = S.table(spark, d, "customer").select("c_custkey", "c_name")
    m = _author_to_org(spark, d).select("author_id", "highest_level_organization_name", "country_name")
    return J.dim_lookup(
        cust, m, "c_custkey", "author_id",
        {"highest_level_organization_name": "Unknown Organization", "country_name": "Unknown Country"},
    )


@register(
    "semi_join_nodes",
    with_(OH, ATO, edges_sql("author"))
    + "SELECT * FROM ato WHERE author_name IN (SELECT node1 FROM e WHERE weight >= 3 UNION SELECT node2 FROM e WHERE weight >= 3)",
)
def semi_join_nodes(spark, d):
    e = G.weight_threshold(edges(spark, d, "author"), "weight", 3)
    return J.semi_join_nodes(_author_to_org(spark, d), e, "author_name")


@register(
    "anti_join_leakage",
    "SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) < 2000 "
    "AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2000)",
)
def anti_join_leakage(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    train = o.filter(F.col("y") < 2000).drop("y")
    test = o.filter(F.col("y") >= 2000).drop("y")
    return J.anti_join_leakage(train, test, "o_custkey")


# author rows deduplicated, with a per-(publication) score standing in for impact
SCORED = """sc AS (SELECT DISTINCT publication_id, concatenated_name FROM arows),
ps AS (SELECT sc.publication_id, sc.concatenated_name, p.altmetric_score AS impact_score FROM sc JOIN pwh p ON p.publication_id = sc.publication_id)"""


def _scored(spark, d):
    rows = _arows(spark, d).select("publication_id", "concatenated_name").distinct()
    pw = _pw(spark, d).select("publication_id", F.col("altmetric_score").alias("impact_score"))
    return rows, rows.join(pw, "publication_id")


@register(
    "fanout_join",
    with_(LINE, AROWS, PWH, SCORED)
    + "SELECT sc.publication_id, sc.concatenated_name, ROUND(ps.impact_score, 6) AS impact_score FROM sc LEFT JOIN ps ON ps.publication_id = sc.publication_id",
)
def fanout_join(spark, d):
    """Faithful: joined on publication only (m x m rows per publication)."""
    rows, scores = _scored(spark, d)
    return rounded(J.fanout_join(rows, scores, "publication_id", "concatenated_name"))


@register(
    "fanout_join_corrected",
    with_(LINE, AROWS, PWH, SCORED)
    + "SELECT sc.publication_id, sc.concatenated_name, ROUND(ps.impact_score, 6) AS impact_score FROM sc LEFT JOIN ps "
    "ON ps.publication_id = sc.publication_id AND ps.concatenated_name = sc.concatenated_name",
)
def fanout_join_corrected(spark, d):
    rows, scores = _scored(spark, d)
    return rounded(J.fanout_join(rows, scores, "publication_id", "concatenated_name", corrected=True))


@register(
    "chunked_merge",
    with_(LINE, AROWS, PWH, SCORED)
    + "SELECT sc.publication_id, sc.concatenated_name, ROUND(ps.impact_score, 6) AS impact_score FROM sc LEFT JOIN ps ON ps.publication_id = sc.publication_id",
)
def chunked_merge(spark, d):
    """The reference merges in 100k-row chunks for memory; Spark's partitioned join gives the same rows."""
    rows, scores = _scored(spark, d)
    return rounded(J.fanout_join(rows, scores, "publication_id", "concatenated_name"))


@register(
    "column_concat",
    with_(LINE, PWH, DSC_OK)
    + "SELECT p.publication_id, p.year, p.times_cited, dsk.dataset_count FROM pwh p JOIN dsk ON CAST(dsk.publication_id AS VARCHAR) = p.publication_id",
)
def column_concat(spark, d):
    a = _pw(spark, d).select("publication_id", "year", "times_cited")
    b = _datasets_per_pub(spark, d, False).select(F.col("publication_id").cast("string").alias("publication_id"), "dataset_count")
    b = b.withColumn("year", F.lit(0).cast("bigint"))  # duplicate column: A's value wins
    return J.column_concat(a, b, "publication_id")


@register(
    "mask_align",
    "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE COALESCE(l.quality = 1, false)",
)
def mask_align(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "lang")
    mask = S.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("keep"))
    return J.mask_align(docs, mask, "doc_id", "keep")


# ------------------------------------------------------------ aggregates (2.5)


@register(
    "count_distinct_group",
    with_(OH) + "SELECT publication_year, organization_name, COUNT(DISTINCT author_id) AS n_authors FROM oh GROUP BY 1, 2",
)
def count_distinct_group(spark, d):
    oh = S.org_hierarchy(spark, d)
    return A.count_distinct_group(oh, ["publication_year", "organization_name"], "author_id", "n_authors")


#: scalar columns of a flattened publication
PUB_SCALARS = [
    "year", "date", "publication_type", "clinical_trial_ids", "citation_count", "times_cited", "recent_citations", "field_citation_ratio", "relative_citation_ratio",
    "altmetric_score", "is_open_access", "unique_org_ids", "research_org_city_ids", "research_org_country_codes", "research_org_state_codes", "num_unique_orgs",
]


@register(
    "group_by_many",
    with_(LINE, PWH)
    + "SELECT publication_id, "
    + ", ".join(f"ROUND({c}, 6) AS {c}" if c in ("field_citation_ratio", "relative_citation_ratio", "altmetric_score", "citation_count") else c for c in PUB_SCALARS)
    + ", CAST(GREATEST(n_authors, 1) AS BIGINT) AS n_rows FROM pwh",
)
def group_by_many(spark, d):
    """Publication x author rows back to publications: grouped on the id, every scalar column carried."""
    rows = _pw(spark, d).select("publication_id", *PUB_SCALARS, F.explode_outer("authors").alias("author"))
    g = A.group_by_many(rows, "publication_id", PUB_SCALARS)
    n = rows.groupBy("publication_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(g.join(n, "publication_id"))


@register(
    "group_size",
    "SELECT CAST(day(ts) AS BIGINT) AS year, event_type AS cluster, COUNT(*) AS count FROM events GROUP BY 1, 2",
)
def group_size(spark, d):
    return A.group_size(S.theme_events(spark, d), ["year", "cluster"])


@register(
    "pivot_matrix",
    """SELECT CAST(day(ts) AS BIGINT) AS year, COUNT(*) FILTER (WHERE event_type = 'click') AS click,
  COUNT(*) FILTER (WHERE event_type = 'error') AS error, COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase,
  COUNT(*) FILTER (WHERE event_type = 'signup') AS signup, COUNT(*) FILTER (WHERE event_type = 'view') AS view
FROM events GROUP BY 1""",
)
def pivot_matrix(spark, d):
    counts = A.group_size(S.theme_events(spark, d), ["year", "cluster"])
    return A.pivot_matrix(counts, "year", "cluster", "count")


@register(
    "first_non_null",
    with_(LINE, AROWS) + "SELECT publication_id, concatenated_name, arg_min(n_name, pos) AS organization FROM arows GROUP BY 1, 2",
)
def first_non_null(spark, d):
    rows = N.author_rows(_pw(spark, d)).select(
        "publication_id", "concatenated_name", "pos", F.get(F.col("author.author_grid_ids"), 0).alias("grid")
    )
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("grid"), F.col("n_name").alias("organization"))
    return A.first_non_null(rows.join(n, "grid", "left"), ["publication_id", "concatenated_name"], "organization", "pos")


@register(
    "duplicate_report",
    with_(LINE, AROWS) + "SELECT publication_id, concatenated_name, COUNT(*) AS count FROM arows GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def duplicate_report(spark, d):
    return A.duplicate_report(_arows(spark, d), ["publication_id", "concatenated_name"])


@register(
    "min_max_range",
    with_(OH, edges_sql("author"))
    + """, x AS (SELECT 'raw' AS metric, CAST(weight AS DOUBLE) AS v FROM e
  UNION ALL SELECT 'share', CAST(weight AS DOUBLE) / (SELECT MAX(weight) FROM e) FROM e
  UNION ALL SELECT 'constant', 2.0 FROM e)
SELECT metric, ROUND(MIN(v), 6) AS min, ROUND(MAX(v), 6) AS max,
  CASE WHEN metric = 'raw' THEN 1.0 WHEN MAX(v) = MIN(v) THEN 0.01 ELSE ROUND((MAX(v) - MIN(v)) / 50.0, 5) END AS step,
  array_to_string(list_transform(range(5), lambda i: CAST(ROUND(MIN(v) + i * (MAX(v) - MIN(v)) / 4.0, 6) AS VARCHAR)), ';') AS marks
FROM x GROUP BY metric""",
)
def min_max_range(spark, d):
    """Slider ranges of the raw weight, its share of the largest, and a constant metric."""
    e = edges(spark, d, "author").select("weight")
    top = e.agg(F.max("weight").alias("top")).scalar()
    parts = [("raw", F.col("weight"), True), ("share", F.col("weight").cast("double") / top, False), ("constant", F.lit(2.0), False)]
    out = None
    for name, value, whole in parts:
        r = A.min_max_range(e.select(value.alias("v")), "v", whole=whole).withColumn("metric", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return rounded(out.select("metric", "min", "max", "step", F.array_join(F.transform("marks", lambda m: F.round(m, 6).cast("string")), ";").alias("marks")))


@register(
    "vector_mean",
    "SELECT label, CAST(i - 1 AS INTEGER) AS dim, ROUND(AVG(v), 6) AS value FROM "
    "(SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i",
)
def vector_mean(spark, d):
    v = S.vectors(spark, d)
    m = A.vector_mean(v, "label", "vec")
    return rounded(m.select("label", F.posexplode("mean_vec").alias("dim", "value")))


@register(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT COUNT(*) AS n_rows, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null, CAST(MIN({c}) AS VARCHAR) AS min, CAST(MAX({c}) AS VARCHAR) AS max FROM customer"
        for c in ("c_custkey", "c_name", "c_acctbal")
    ),
)
def null_profile(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return A.null_profile(c)


# predictions stand-in: least-squares fit of altmetric score on times cited, per year as fold
PRED = """pred AS (SELECT p.year AS fold, p.publication_id, p.altmetric_score AS actual,
  f.b + f.a * p.times_cited AS predicted FROM pwh p CROSS JOIN
  (SELECT regr_slope(altmetric_score, times_cited) AS a, regr_intercept(altmetric_score, times_cited) AS b FROM pwh) f
  WHERE p.times_cited IS NOT NULL)"""


def _predictions(spark, d):
    from citegraph.operators.scoring import linear_fit_predict

    pw = _pw(spark, d).filter(F.col("times_cited").isNotNull())
    return linear_fit_predict(pw, "times_cited", "altmetric_score").select(
        F.col("year").alias("fold"), "publication_id", F.col("altmetric_score").alias("actual"), "predicted"
    )


@register("pearson", with_(LINE, PWH, PRED) + "SELECT ROUND(corr(actual, predicted), 6) AS pearson, COUNT(*) AS n FROM pred")
def pearson(spark, d):
    return rounded(A.pearson(_predictions(spark, d), "actual", "predicted"))


@register(
    "spearman",
    with_(LINE, PWH, PRED)
    + """, rk AS (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY actual) + (COUNT(*) OVER (PARTITION BY fold, actual) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY fold ORDER BY predicted) + (COUNT(*) OVER (PARTITION BY fold, predicted) - 1) / 2.0 AS rb FROM pred)
SELECT fold, ROUND(corr(ra, rb), 6) AS spearman FROM rk GROUP BY fold""",
)
def spearman(spark, d):
    return rounded(A.spearman(_predictions(spark, d), "actual", "predicted", ["fold"]))


@register(
    "rmse_mae",
    with_(LINE, PWH, PRED)
    + "SELECT fold, ROUND(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, ROUND(avg(abs(actual - predicted)), 6) AS mae FROM pred GROUP BY fold",
)
def rmse_mae(spark, d):
    return rounded(A.rmse_mae(_predictions(spark, d), "fold", "actual", "predicted"))


@register(
    "residual_join",
    with_(LINE, PWH, PRED)
    + "SELECT p.publication_id, p.year, ROUND(pr.actual - pr.predicted, 6) AS Diff FROM pwh p LEFT JOIN pred pr ON pr.publication_id = p.publication_id",
)
def residual_join(spark, d):
    pw = _pw(spark, d).select("publication_id", "year")
    return rounded(J.residual_join(_predictions(spark, d), pw, "publication_id", "actual", "predicted"))


# --------------------------------------------------------------- windows (2.6)

TE = """te AS (SELECT CAST(day(ts) AS BIGINT) AS year, event_type AS cluster, event_id, user_id, value FROM events),
cnt AS (SELECT year, cluster, COUNT(*) AS count FROM te GROUP BY 1, 2)"""


def _counts(spark, d):
    return A.group_size(S.theme_events(spark, d), ["year", "cluster"])


@register(
    "row_number_global",
    "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS row_num FROM orders",
)
def row_number_global(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return Wn.row_number_global(o, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register(
    "group_transform_nunique",
    with_(LINE, AROWS) + "SELECT a.publication_id, a.concatenated_name, n.num_publications FROM arows a JOIN "
    "(SELECT concatenated_name, COUNT(DISTINCT publication_id) AS num_publications FROM arows GROUP BY 1) n USING (concatenated_name)",
)
def group_transform_nunique(spark, d):
    rows = _arows(spark, d).select("publication_id", "concatenated_name")
    return Wn.group_transform_nunique(rows, "concatenated_name", "publication_id", "num_publications")


@register(
    "pct_change",
    with_(TE) + "SELECT year, cluster, count, ROUND((CAST(count AS DOUBLE) / LAG(count) OVER (PARTITION BY cluster ORDER BY year) - 1) * 100, 6) AS growth_rate FROM cnt",
)
def pct_change(spark, d):
    return rounded(Wn.pct_change(_counts(spark, d), "cluster", "year", "count"))


@register(
    "relative_share",
    with_(TE) + "SELECT c.year, cluster, count, t.total_count, ROUND(CAST(count AS DOUBLE) / t.total_count * 100, 6) AS relative_share "
    "FROM cnt c JOIN (SELECT year, CAST(SUM(count) AS BIGINT) AS total_count FROM cnt GROUP BY year) t ON t.year = c.year",
)
def relative_share(spark, d):
    return rounded(Wn.relative_share(_counts(spark, d), "year", "count"))


@register(
    "trend_slope",
    with_(TE) + ", sh AS (SELECT c.year, cluster, CAST(count AS DOUBLE) / t.tot * 100 AS share FROM cnt c JOIN "
    "(SELECT year, SUM(count) AS tot FROM cnt GROUP BY year) t ON t.year = c.year) "
    "SELECT cluster, ROUND(COALESCE(regr_slope(share, CAST(year AS DOUBLE)), 0.0), 6) AS slope FROM sh GROUP BY cluster",
)
def trend_slope(spark, d):
    share = Wn.relative_share(_counts(spark, d), "year", "count")
    return rounded(Wn.trend_slope(share, "cluster", "year", "relative_share"))


@register(
    "dense_relabel",
    with_(TE) + "SELECT t.event_id, t.cluster, r.label_rank FROM te t JOIN (SELECT cluster, ROW_NUMBER() OVER (ORDER BY MIN(year * 1000000000 + event_id), cluster) AS label_rank "
    "FROM te GROUP BY cluster) r USING (cluster)",
)
def dense_relabel(spark, d):
    te = S.theme_events(spark, d).select("event_id", "cluster", "year")
    return Wn.dense_relabel(te, "cluster", "year", "event_id").select("event_id", "cluster", F.col("label_rank").cast("bigint").alias("label_rank"))


@register(
    "rescale_labels",
    "SELECT vec_id, CAST(ROUND_EVEN(1 + (label - m.mn) * 19.0 / (m.mx - m.mn), 0) AS INTEGER) AS label20 FROM embeddings "
    "CROSS JOIN (SELECT MIN(label) AS mn, MAX(label) AS mx FROM embeddings) m",
)
def rescale_labels(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", "label")
    return Wn.rescale_labels(e, "label", 1, 20, "label20").select("vec_id", "label20")


@register(
    "minmax_normalise",
    "SELECT c_custkey, ROUND((c_acctbal - m.a0) / CASE WHEN m.a1 <> m.a0 THEN m.a1 - m.a0 ELSE 1 END, 6) AS normalized_c_acctbal, "
    "ROUND((c_nationkey - m.n0) / CASE WHEN m.n1 <> m.n0 THEN m.n1 - m.n0 ELSE 1 END, 6) AS normalized_c_nationkey "
    "FROM customer CROSS JOIN (SELECT MIN(c_acctbal) a0, MAX(c_acctbal) a1, MIN(c_nationkey) n0, MAX(c_nationkey) n1 FROM customer) m",
)
def minmax_normalise(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return rounded(Wn.minmax_normalise(c, ["c_acctbal", "c_nationkey"]).drop("c_acctbal", "c_nationkey"))


@register(
    "gaps_and_islands",
    with_(TE) + """, sh AS (SELECT c.year, cluster, CAST(count AS DOUBLE) / t.tot AS share FROM cnt c
  JOIN (SELECT year, SUM(count) AS tot FROM cnt GROUP BY year) t ON t.year = c.year),
f AS (SELECT cluster, year, year - ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY year) AS g FROM sh WHERE share >= 0.2)
SELECT cluster, MIN(year) AS start, MAX(year) AS "end" FROM f GROUP BY cluster, g""",
)
def gaps_and_islands(spark, d):
    share = Wn.relative_share(_counts(spark, d), "year", "count")
    return Wn.gaps_and_islands(share, "year", F.col("relative_share") >= 20.0, ["cluster"])


@register(
    "topk_per_group",
    "SELECT * FROM (SELECT c_nationkey, c_custkey, c_name, c_acctbal, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS rank FROM customer) WHERE rank <= 3",
)
def topk_per_group(spark, d):
    c = S.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    return Wn.topk_per_group(c, "c_nationkey", "c_acctbal", "c_name", 3)


@register(
    "keep_first_dedup",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def keep_first_dedup(spark, d):
    o = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return Wn.keep_first_dedup(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register(
    "ecdf",
    "SELECT DISTINCT event_type, value, ROUND(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS F FROM events",
)
def ecdf(spark, d):
    e = S.table(spark, d, "events").select("event_type", "value")
    return rounded(Wn.ecdf(e, "event_type", "value"))


@register(
    "local_peaks",
    with_(TE) + """SELECT cluster, year, count, count - LAG(count) OVER w AS d1, LEAD(count) OVER w - 2 * count + LAG(count) OVER w AS d2,
  COALESCE(count > LAG(count) OVER w AND count >= LEAD(count) OVER w, false) AS is_peak
FROM cnt WINDOW w AS (PARTITION BY cluster ORDER BY year)""",
)
def local_peaks(spark, d):
    return Wn.local_peaks(_counts(spark, d), "cluster", "year", "count")


# ------------------------------------------------------------ sorts (2.7)


@register("order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def order_by(spark, d):
    return O.order_by(S.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"])


@register("top_n", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 30")
def top_n(spark, d):
    return O.top_n(S.table(spark, d, "customer").select("c_name", "c_acctbal"), "c_acctbal", 30, "c_name")


@register("offset_slice", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 25 OFFSET 1")
def offset_slice(spark, d):
    c = S.table(spark, d, "customer").select("c_name", "c_acctbal")
    return O.offset_slice(c, [F.col("c_acctbal").desc(), "c_name"], 1, 25)


@register(
    "sample_fraction",
    "SELECT doc_id, lang FROM documents WHERE CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3",
)
def sample_fraction(spark, d):
    """Deterministic 30 % sample of documents (hash of id and seed 42)."""
    return O.sample_fraction(S.table(spark, d, "documents").select("doc_id", "lang"), 0.3, 42, key="doc_id")


# --------------------------------------------------------------- sets (2.8)

NODES = """n1 AS (SELECT node1 AS node FROM e WHERE year = 1997 UNION ALL SELECT node2 FROM e WHERE year = 1997),
n2 AS (SELECT node1 AS node FROM e WHERE year = 1998 UNION ALL SELECT node2 FROM e WHERE year = 1998)"""


def _nodes(spark, d, year):
    e = edges(spark, d, "author").filter(F.col("year") == year)
    return e.select(F.col("node1").alias("node")).unionByName(e.select(F.col("node2").alias("node")))


@register("union_all", with_(OH, edges_sql("author"), NODES) + "SELECT node FROM n1 UNION ALL SELECT node FROM n2")
def union_all(spark, d):
    return O.union_all(_nodes(spark, d, 1997), _nodes(spark, d, 1998))


@register("union_distinct", with_(OH, edges_sql("author"), NODES) + "SELECT node FROM n1 UNION SELECT node FROM n2")
def union_distinct(spark, d):
    return O.union_distinct(_nodes(spark, d, 1997), _nodes(spark, d, 1998))


@register("intersect", with_(OH, edges_sql("author"), NODES) + "SELECT node FROM n1 INTERSECT SELECT node FROM n2")
def intersect(spark, d):
    return O.intersect(_nodes(spark, d, 1997), _nodes(spark, d, 1998))


@register("except", with_(OH, edges_sql("author"), NODES) + "SELECT node FROM n1 EXCEPT SELECT node FROM n2")
def except_(spark, d):
    return O.except_(_nodes(spark, d, 1997), _nodes(spark, d, 1998))


@register("except_nodes", with_(OH, edges_sql("author"), NODES) + "SELECT node FROM n1 EXCEPT SELECT node FROM n2")
def except_nodes(spark, d):
    """Authors of 1997's graph that are not in 1998's."""
    return O.except_(_nodes(spark, d, 1997), _nodes(spark, d, 1998))


@register(
    "token_distinct_count",
    with_(LINE, PWH)
    + "SELECT publication_id, CASE WHEN research_org_country_codes IS NULL THEN 0 ELSE len(list_distinct(string_split(research_org_country_codes, ','))) END AS num_unique_country_codes FROM pwh",
)
def token_distinct_count(spark, d):
    pw = _pw(spark, d)
    return pw.select("publication_id", C.token_distinct_count("research_org_country_codes").cast("bigint").alias("num_unique_country_codes"))


@register("array_length", with_(LINE, PWH) + "SELECT publication_id, n_authors AS num_authors FROM pwh")
def array_length(spark, d):
    """Number of author structs of every publication (true array size)."""
    return _pw(spark, d).select("publication_id", F.size("authors").cast("bigint").alias("num_authors"))
