"""Catalog: scans and sinks.

Each query first writes its input files from the test tables (JSON-lines
shards, CSV shards, year-partitioned parquet ...) under a fresh folder of
the session's shared checkpoint directory, then reads them back with the
library's scan - the scan is the operator under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.plans import standins as S
from citegraph.plans.graph_queries import edges
from citegraph.plans.registry import register
from citegraph.plans.sqlparts import LINE, OH, edges_sql, with_
from citegraph.session import checkpoint_dir
from citegraph.sources import files as IO


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex[:12]}"


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
    ]
)


def _nested_events(spark, d):
    e = S.table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props"))


@register(
    "scan_json_shards",
    """SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""",
)
def scan_json_shards(spark, d):
    path = _folder(spark, "json")
    _nested_events(spark, d).repartition(4).write.option("compression", "gzip").json(path)
    return IO.scan_json_shards(spark, f"{path}/*.json.gz", EVENT_SCHEMA).drop("shard")


@register(
    "scan_tolerant",
    "SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'",
)
def scan_tolerant(spark, d):
    """Lines of 'error' events are written truncated (corrupt); the scan keeps the good rows."""
    path = _folder(spark, "tolerant")
    ne = _nested_events(spark, d)
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    txt = F.when(F.col("event_type") == "error", F.expr("substring(to_json(struct(event_id, user_id, event_type, value, props)), 1, 12)")).otherwise(line)
    ne.select(txt.alias("value")).repartition(3).write.text(path)
    good, bad = IO.scan_tolerant(spark, f"{path}/*.txt", EVENT_SCHEMA)
    return good.select("event_id", "user_id", "event_type", "value", F.col("props.k").alias("k"))


@register(
    "scan_tolerant_bad_lines",
    "SELECT COUNT(*) AS bad_lines FROM events WHERE event_type = 'error'",
)
def scan_tolerant_bad_lines(spark, d):
    path = _folder(spark, "tolerant-bad")
    ne = _nested_events(spark, d)
    txt = F.when(
        F.col("event_type") == "error", F.expr("substring(to_json(struct(event_id, user_id, event_type, value, props)), 1, 12)")
    ).otherwise(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")))
    ne.select(txt.alias("value")).repartition(3).write.text(path)
    _, bad = IO.scan_tolerant(spark, f"{path}/*.txt", EVENT_SCHEMA)
    return bad.agg(F.count(F.lit(1)).alias("bad_lines"))


EDGE_SCHEMA = "year BIGINT, node1 STRING, node2 STRING, weight BIGINT"


@register("scan_csv_shards", with_(OH, edges_sql("org")) + "SELECT * FROM e")
def scan_csv_shards(spark, d):
    path = _folder(spark, "csv")
    edges(spark, d, "org").repartition(5).write.option("header", True).csv(path)
    return IO.scan_csv_shards(spark, f"{path}/*.csv", EDGE_SCHEMA, not_null=["node1", "node2"])


OH_SCHEMA = (
    "publication_id BIGINT, publication_year BIGINT, author_id BIGINT, author_name STRING, org_id BIGINT, "
    "organization_name STRING, country_name STRING, high_level_org_id BIGINT, high_level_org_name STRING, "
    "low_level_org_id BIGINT, low_level_org_name STRING"
)


@register("scan_csv_typed", with_(OH) + "SELECT * FROM oh")
def scan_csv_typed(spark, d):
    path = _folder(spark, "csv-typed")
    S.org_hierarchy(spark, d).write.option("header", True).csv(path)
    return IO.scan_csv_shards(spark, f"{path}/*.csv", OH_SCHEMA)


@register(
    "scan_csv_encoding_fallback",
    "SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents",
)
def scan_csv_encoding_fallback(spark, d):
    """Whole texts of all documents written as ISO-8859-1 in several shards; the UTF-8 probe fails and the scan falls back."""
    path = _folder(spark, "latin1")
    docs = S.table(spark, d, "documents").select("doc_id", "lang", "text").repartition(4, "doc_id")
    writer = docs.write.option("header", True).option("encoding", "ISO-8859-1").option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = IO.scan_csv_encoding_fallback(spark, f"{path}/*.csv", "doc_id BIGINT, lang STRING, text STRING")
    return got.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _year_dataset(spark, d):
    path = _folder(spark, "by-year")
    IO.write_by_year(edges(spark, d, "org"), path)
    return path


@register("write_by_year", with_(OH, edges_sql("org")) + "SELECT * FROM e")
def write_by_year(spark, d):
    path = _year_dataset(spark, d)
    return spark.read.parquet(path).select("year", "node1", "node2", "weight").withColumn("year", F.col("year").cast("bigint"))


@register("scan_parquet_checked", with_(OH, edges_sql("org")) + "SELECT node1, node2, weight FROM e WHERE year = 1998")
def scan_parquet_checked(spark, d):
    path = _year_dataset(spark, d)
    return IO.scan_parquet_checked(spark, path, 1998).select("node1", "node2", "weight")


@register("available_years", with_(OH, edges_sql("org")) + "SELECT DISTINCT CAST(year AS INTEGER) AS year FROM e")
def available_years(spark, d):
    path = _year_dataset(spark, d)
    return IO.available_years(spark.read.parquet(path)).select(F.col("year").cast("int").alias("year"))


@register(
    "scan_mapping",
    with_(LINE) + "SELECT DISTINCT split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS author_name, n_name AS highest_level_organization_name FROM line",
)
def scan_mapping(spark, d):
    from citegraph.plans.scoring_queries import _author_org

    path = _folder(spark, "mapping")
    _author_org(spark, d).write.parquet(path)
    return IO.scan_mapping(spark, path, ["author_name", "highest_level_organization_name"])


@register(
    "write_by_org",
    with_(OH, edges_sql("org"))
    + "SELECT DISTINCT year, node1, node2, weight, org FROM (SELECT year, node1, node2, weight, node1 AS org FROM e UNION ALL SELECT year, node1, node2, weight, node2 FROM e)",
)
def write_by_org(spark, d):
    path = _folder(spark, "by-org")
    IO.write_by_org(edges(spark, d, "org"), path)
    return spark.read.parquet(path).withColumn("year", F.col("year").cast("bigint"))


@register("csv_to_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_to_parquet(spark, d):
    src = _folder(spark, "cust-csv")
    dst = _folder(spark, "cust-parquet")
    S.table(spark, d, "customer").write.option("header", True).csv(src)
    IO.csv_to_parquet(spark, f"{src}/*.csv", dst, "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING")
    return spark.read.parquet(dst)


@register(
    "create_table_as",
    "SELECT o.o_orderkey AS publication_id, COUNT(ds.l_orderkey) AS dataset_count FROM orders o "
    "LEFT JOIN lineitem ds ON ds.l_orderkey = o.o_orderkey AND ds.l_returnflag = 'R' GROUP BY o.o_orderkey",
)
def create_table_as(spark, d):
    from citegraph.plans.relational_queries import _datasets_per_pub

    path = _folder(spark, "ctas")
    IO.create_table_as(_datasets_per_pub(spark, d, False), path, replace=True)
    IO.create_table_as(_datasets_per_pub(spark, d, False), path, replace=True)  # OR REPLACE
    return spark.read.parquet(path)


@register(
    "parametrised_lookup",
    with_(OH) + "SELECT DISTINCT author_id, author_name, organization_name FROM oh WHERE author_id IN "
    "(SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)",
)
def parametrised_lookup(spark, d):
    ids = S.table(spark, d, "supplier").filter(F.col("s_nationkey") == 3).select(F.col("s_suppkey").alias("author_id"))
    oh = S.org_hierarchy(spark, d).select("author_id", "author_name", "organization_name").distinct()
    return IO.parametrised_lookup(oh, ids, "author_id")
