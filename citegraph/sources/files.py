"""Scans and sinks (#1-#13).

All reads take an explicit schema (no inference pass over the data), and
all multi-file reads are one glob scan, so shards are read in parallel by
Spark tasks instead of a driver-side loop. Writes are partitioned datasets
(``partitionBy('year')``) rather than one file per year or organisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.session import cut_lineage

CORRUPT = "_corrupt_record"


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Raise when a required column is missing (the reference returns an empty table)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields -> top-level columns named with dotted paths (``json_normalize``)."""

    def walk(dt: T.StructType, prefix: list[str]):
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield path

    cols = [F.col("`" + "`.`".join(p) + "`").alias(sep.join(p)) for p in walk(df.schema, [])]
    return df.select(*cols)


def scan_json_shards(spark: SparkSession, glob: str, schema: T.StructType | str, flatten: bool = True) -> DataFrame:
    """JSON-lines shards (gzip read natively), union of all, nested keys flattened (#1).

    ``shard`` holds the shard's file name so that the shard order of the
    reference (by shard number) stays available as a column.
    """
    df = spark.read.schema(schema).json(glob)
    out = flatten_struct(df) if flatten else df
    return out.withColumn("shard", F.input_file_name())


def scan_tolerant(spark: SparkSession, glob: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split shards' lines into (good rows, bad lines) instead of failing the job (#2).

    A shard that cannot be read (a broken gzip file) gives the lines before the
    break, none where there are none, and Spark logs its name.
    """
    s = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(s)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreCorruptFiles", "true")
        .json(glob)
        .withColumn("_file", F.input_file_name())
    )
    df = cut_lineage(df)  # read twice: parsed once
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")
    bad = df.filter(F.col(CORRUPT).isNotNull()).select("_file", CORRUPT)
    return good, bad


def scan_csv_shards(spark: SparkSession, glob: str, schema: T.StructType | str, not_null: list[str] | None = None) -> DataFrame:
    """Header CSV shards with an explicit schema; rows with NULL in ``not_null`` dropped (#3, #4)."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(glob)
    return df.dropna(subset=not_null) if not_null else df


def scan_csv_encoding_fallback(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read as UTF-8; if any line is not valid UTF-8, read as ISO-8859-1 (#5).

    Quotes inside a cell are doubled. The probes are distributed filters with
    ``limit(1)`` over the raw lines: they stop at the first hit and move no
    data to the driver. Only where a line has an odd number of quotes, so that
    a cell goes over several lines, are files read whole (``multiLine``);
    otherwise they are split like any text.
    """
    lines = spark.read.text(path)
    latin = lines.filter(~F.is_valid_utf8("value")).limit(1).count()
    broken = lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).count()
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", bool(broken)).option("encoding", "ISO-8859-1" if latin else "UTF-8").csv(path)


def write_by_year(df: DataFrame, path: str, mode: str = "overwrite", sort_cols: tuple = ("node1", "node2")) -> None:
    """One dataset partitioned by year (replaces per-year files + combined file) (#9).

    Range partitioning on (year, sort columns) balances the write tasks (a
    year is split over many tasks instead of one task per year) and keeps
    each file sorted, so min/max statistics skip row groups on later reads.
    """
    keys = ["year", *[c for c in sort_cols if c in df.columns]]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("year").parquet(path)


def scan_parquet_checked(spark: SparkSession, path: str, year: int | None = None, required=("node1", "node2", "weight")) -> DataFrame:
    """Year-partitioned edge dataset, pruned to one year, required columns checked (#6)."""
    df = spark.read.parquet(path)
    if year is not None:
        df = df.filter(F.col("year") == F.lit(year))
    return require_columns(df, required)


def scan_mapping(spark: SparkSession, path: str, required) -> DataFrame:
    """Mapping table with a required-column check (#7)."""
    return require_columns(spark.read.parquet(path), required)


def available_years(df: DataFrame) -> DataFrame:
    """Sorted distinct years (partition values of a year-partitioned table) (#8)."""
    return df.select("year").distinct().orderBy("year")


def write_by_org(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every edge touching an organisation, per (year, org) (#10).

    Self-loops are listed once per organisation. Data is partitioned by
    year and clustered on org inside the files (no directory per org).
    """
    per_org = edges.select(
        "year", "node1", "node2", "weight", F.explode(F.array_distinct(F.array("node1", "node2"))).alias("org")
    )
    # range partitions on (year, org, other end): a very large organisation
    # spreads over several write tasks, and files stay sorted by org
    (
        per_org.withColumn("_other", F.when(F.col("org") == F.col("node1"), F.col("node2")).otherwise(F.col("node1")))
        .repartitionByRange("year", "org", "_other")
        .sortWithinPartitions("year", "org", "_other")
        .drop("_other")
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def csv_to_parquet(spark: SparkSession, src_glob: str, dst: str, schema: T.StructType | str) -> None:
    """Convert CSV files to one parquet dataset (#11)."""
    spark.read.schema(schema).option("header", True).csv(src_glob).write.mode("overwrite").parquet(dst)


def create_table_as(df: DataFrame, path: str, replace: bool = True) -> None:
    """CREATE [OR REPLACE] TABLE ... AS SELECT, as a parquet table at ``path`` (#12)."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def parametrised_lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the caller's id list, as a semi-join (#13)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
