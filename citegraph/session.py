"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a local test session gets; on a cluster the deployment's own
# configuration wins because ``getOrCreate`` returns the running session.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "citegraph", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("CITEGRAPH_MASTER", "local[8]"))
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment names a shared folder and it is used as is;
    without one this raises, since a machine-local folder would not be seen
    by other machines. Only a local session (tests) gets a scratch folder of
    its own. The folder is registered for checkpoints once per session.
    """
    sc = spark.sparkContext
    registered = sc.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or registered
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="citegraph-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if not registered:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used by the iterative operators so that plans do not grow with the
    iteration count; the files survive executor loss. Unlike an eager
    checkpoint, the last stage runs once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextmanager
def wide_shuffles(spark: SparkSession, rows: int, rows_per_task: int = 250_000):
    """Shuffles of what runs inside have a partition for every ``rows_per_task`` of ``rows``.

    A deployment's fixed number of partitions makes tasks grow with the input;
    inside the block it is only a lower bound, and partitions are not merged.
    What runs inside must be written there (``cut_lineage``): a lazy result
    gets the settings of the time it is read.
    """
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {c: spark.conf.get(c) for c in names}
    wide = -(-rows // rows_per_task)
    if wide > int(before[names[0]]):
        spark.conf.set(names[0], str(wide))
        spark.conf.set(names[1], "false")
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote and that nothing reads any more.

    The loops of iterative operators call it for a round's state once the next
    one is written, so that a run keeps two states and not one for each round.
    """
    path = getattr(df, "_written", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)
