"""Shared helpers: tables written once to the shared folder, row identity."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.session import checkpoint_dir

#: words of the contracts: runs of anything but space and \t..\r
WORD = r"[^\x20\x09-\x0D]+"


#: bytes of an Arrow batch that goes to a Python worker, at most
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, where it is above.

    Workers and the JVM keep buffers as large as the largest batch; by rows
    alone a batch of long texts takes hundreds of megabytes.
    """
    digits, unit = re.fullmatch(r"(\d+)\s*([kmg]?)b?", spark.conf.get(_BATCH).lower()).groups()
    if int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage; the files survive lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns as the one struct ``_row``: no name can clash with a helper's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def text_key(text: Column) -> Column:
    """64-bit hash of a text, the same for equal texts (null included)."""
    return F.xxhash64(text)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
