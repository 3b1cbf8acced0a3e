"""Skew-safe pairing inside groups.

Several operators pair rows that share a group key (authors of one
publication, items of one cluster). A plain self-join on the group key
sends a whole group to one task; when one group holds a large share of the
data that task does quadratic work alone. ``pairs_within_groups`` splits
such hot groups:

1. group sizes are counted with a partial (map-side) aggregation;
2. groups above ``hot_rows`` get ``ceil(size / hot_rows)`` salts; the hot
   list has at most ``total / hot_rows`` rows and is broadcast only when its
   counted size is below ``max_broadcast_rows`` (else it is shuffle-joined
   and AQE's skew-join split handles the rest);
3. the left side takes one salt per row from a hash of its key (stable under
   task retry, unlike ``rand()``), the right side is replicated over all
   salts of its group, and the join key is ``(group, salt)``.

Every ordered pair ``left.key < right.key`` is produced exactly once. The join
has a partition for every ``PAIRS_PER_TASK`` pairs, so that a task's pairs do
not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT_ROWS = 20_000
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
PAIRS_PER_TASK = 500_000


def pairs_within_groups(
    df: DataFrame,
    group_cols: list[str],
    key_col: str,
    left_cols: list[str],
    right_cols: list[str],
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Join ``df`` with itself on ``group_cols`` keeping ``l.key < r.key``.

    Output columns: ``group_cols`` + ``l_<c>`` for ``left_cols`` + ``r_<c>``
    for ``right_cols``.
    """
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).select(
        *group_cols, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts")
    )
    pairs = F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2)
    found = sizes.agg(F.count_if(F.col("_n") > hot_rows).alias("hot"), F.ceil(pairs / pairs_per_task).alias("tasks")).first()
    n_hot, tasks = found["hot"], int(found["tasks"] or 0)
    wide = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda side, *more: side.repartition(tasks, *group_cols, *more) if wide else side
    if n_hot == 0:
        left = dealt(df.select(*group_cols, *[F.col(c).alias(f"l_{c}") for c in left_cols]))
        right = dealt(df.select(*group_cols, *[F.col(c).alias(f"r_{c}") for c in right_cols]))
        return left.join(right, group_cols).filter(F.col(f"l_{key_col}") < F.col(f"r_{key_col}"))
    side = F.broadcast(hot) if n_hot <= max_broadcast_rows else hot
    base = df.join(side, group_cols, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    left = base.select(
        *group_cols,
        F.pmod(F.xxhash64(F.col(key_col)), F.col("_salts")).cast("int").alias("_salt"),
        *[F.col(c).alias(f"l_{c}") for c in left_cols],
    )
    right = base.select(
        *group_cols,
        F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
        *[F.col(c).alias(f"r_{c}") for c in right_cols],
    )
    left, right = dealt(left, "_salt"), dealt(right, "_salt")
    return left.join(right, [*group_cols, "_salt"]).filter(
        F.col(f"l_{key_col}") < F.col(f"r_{key_col}")
    ).drop("_salt")
