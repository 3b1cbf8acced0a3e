"""Reference-shaped inputs derived from the driver's test tables.

The reference reads a nested publication warehouse, an organisation
dimension with parent relationships, text abstracts, embeddings and a
per-theme time series. The test tables are mapped onto those shapes here
and nothing else happens here: every builder only joins / renames / nests
rows into the schema the jobs expect. All job work (deduplication, pairing,
metrics, statistics) lives in ``citegraph.operators``.

Mapping (fixed, see FIXTURES.md section B):

* publication (id, year)        -> order (``o_orderkey``, ``year(o_orderdate)``)
* author of a publication       -> supplier of one of the order's lineitems
* organisation (grid id)        -> the supplier's nation
* parent organisation / country -> the nation's region
* dataset rows of a publication -> lineitems with ``l_returnflag = 'R'``
* grants / patents of an author -> lineitems with ``l_returnflag = 'A'`` / parts supplied
* abstracts, language, theme    -> ``documents.text``, ``documents.lang``, ``documents.source``
* embeddings, planted clusters  -> ``embeddings.embedding``, ``embeddings.label``
* (time, theme) events          -> ``events`` (day of ``ts``, ``event_type``)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _year(c: str) -> Column:
    return F.year(F.col(c)).cast("bigint")


def org_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat affiliation fact, one row per lineitem (so it holds repeats).

    Columns follow the reference's ``org_hierarchy`` table.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("o_orderkey").alias("publication_id"),
            _year("o_orderdate").alias("publication_year"),
            F.col("s_suppkey").alias("author_id"),
            F.col("s_name").alias("author_name"),
            F.col("n_nationkey").cast("bigint").alias("org_id"),
            F.col("n_name").alias("organization_name"),
            F.col("r_name").alias("country_name"),
            F.col("r_regionkey").cast("bigint").alias("high_level_org_id"),
            F.col("r_name").alias("high_level_org_name"),
            F.col("n_nationkey").cast("bigint").alias("low_level_org_id"),
            F.col("n_name").alias("low_level_org_name"),
        )
    )


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested publication records (one row per order).

    ``authors`` is an array of structs with a nested ``affiliations_address``
    array; ``funding_details`` lists the order's parts; ``clinical_trial_ids``
    lists its return flags. Lineitems repeat suppliers, so the arrays hold
    repeats, exactly like the reference's multiplied arrays.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    line = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    author = F.struct(
        F.col("l_suppkey").cast("string").alias("researcher_id"),
        F.get(F.split("s_name", "#"), 0).alias("first_name"),
        F.get(F.split("s_name", "#"), 1).alias("last_name"),
        F.lit(None).cast("string").alias("orcid"),
        F.array(F.col("n_nationkey").cast("string")).alias("grid_ids"),
        F.array(
            F.struct(
                F.col("n_nationkey").cast("string").alias("grid_id"),
                F.lit(None).cast("string").alias("city_id"),
                F.col("n_regionkey").cast("string").alias("country_code"),
                F.lit(None).cast("string").alias("state_code"),
            )
        ).alias("affiliations_address"),
    )
    nested = line.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", author.alias("a")))).alias("lines"),
        F.sum("l_quantity").cast("bigint").alias("times_cited"),
        F.count(F.lit(1)).alias("recent_citations"),
        F.avg("l_discount").alias("field_citation_ratio"),
        F.avg("l_tax").alias("relative_citation_ratio"),
        F.sort_array(F.collect_list("l_returnflag")).alias("clinical_trial_ids"),
    )
    return (
        o.join(nested, o.o_orderkey == nested.l_orderkey, "left")
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            _year("o_orderdate").alias("year"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col("o_orderpriority").alias("type"),
            F.coalesce(F.col("clinical_trial_ids"), F.array().cast("array<string>")).alias("clinical_trial_ids"),
            F.col("o_totalprice").alias("citations_count"),
            F.struct("times_cited", "recent_citations", "field_citation_ratio", "relative_citation_ratio").alias("metrics"),
            F.struct((F.col("o_totalprice") / 1000.0).alias("score")).alias("altmetrics"),
            F.transform(F.coalesce("lines", F.array()), lambda x: x["a"]).alias("authors"),
            F.transform(
                F.coalesce("lines", F.array()),
                lambda x: F.struct(
                    x["l_partkey"].cast("string").alias("grant_id"),
                    x["a"]["grid_ids"][0].alias("grid_id"),
                ),
            ).alias("funding_details"),
        )
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation dimension: one row per nation, its region as 'Parent'."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.struct(
            F.col("r_name").alias("country"),
            F.lit(None).cast("double").alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
        ).alias("address"),
        F.array(
            F.struct(
                F.lit("Parent").alias("type"),
                F.col("r_name").alias("label"),
                F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("id"),
            )
        ).alias("relationships"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset fact: one row per returned ('R') lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_returnflag") == "R").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("dataset_id"),
        F.col("l_orderkey").alias("associated_publication_id"),
    )


def researcher_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-researcher grant and patent rows (raw, not counted)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("researcher_id"),
        F.col("l_returnflag"),
        F.col("l_partkey"),
    )


def publication_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(publication_id, researcher_id) rows with repeats, as in the warehouse view."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("publication_id"),
        F.col("l_suppkey").alias("researcher_id"),
    )


def theme_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, cluster, text, lang, year): ``source`` plays the theme."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("cluster"),
        "text",
        "lang",
    )


def theme_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, cluster) rows: day of the event is the time, type the theme."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.dayofmonth("ts").cast("bigint").alias("year"),
        F.col("event_type").alias("cluster"),
        "event_id",
        "user_id",
        "value",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
