"""Window-style operators.

Windows are always partitioned by a data key that spreads the rows
(cluster, word, author ...). Where the reference computes a whole-table
quantity (global row numbers, global min/max), it is built from an
aggregation joined back, never from an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from citegraph.session import cut_lineage


def row_number_global(df: DataFrame, order: list, out: str = "row_num") -> DataFrame:
    """Consecutive 1-based row numbers in ``order`` without a one-partition window (#82).

    The sort range-partitions the data; each partition then numbers its rows
    locally (``monotonically_increasing_id`` minus the partition base) and
    adds the count of all rows in earlier partitions. The sorted table is
    checkpointed to the shared checkpoint folder, so the counts and the
    numbering read the same partitions even after a task retry.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_df = df.orderBy(*cols).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id()
    )
    sorted_df = cut_lineage(sorted_df)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a single-partition window over it is tiny
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))).alias("_off"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (
        sorted_df.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + local + 1).cast("bigint"))
        .drop("_pid", "_mid", "_off")
    )


def group_transform_nunique(df: DataFrame, key: str, c: str, out: str) -> DataFrame:
    """Distinct count of ``c`` per ``key`` on every row (#83): aggregate + join."""
    n = df.groupBy(key).agg(F.countDistinct(c).alias(out))
    return df.join(n, key, "left")


def pct_change(df: DataFrame, key: str, order: str, c: str, out: str = "growth_rate") -> DataFrame:
    """(c / previous observed c - 1) * 100 per key (#84)."""
    w = W.partitionBy(key).orderBy(order)
    prev = F.lag(c).over(w)
    return df.withColumn(out, (F.try_divide(F.col(c).cast("double"), prev) - 1) * 100)


def relative_share(df: DataFrame, group: str, c: str, total: str = "total_count", out: str = "relative_share") -> DataFrame:
    """c / group total * 100 (#85); the total is an aggregate joined back."""
    t = df.groupBy(group).agg(F.sum(c).alias(total))
    return df.join(t, group).withColumn(out, F.col(c).cast("double") / F.col(total) * 100)


def trend_slope(df: DataFrame, key: str, x: str, y: str, out: str = "slope") -> DataFrame:
    """Least-squares slope of y on x per key; fewer than 2 points -> 0 (#86)."""
    return df.groupBy(key).agg(F.coalesce(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.lit(0.0)).alias(out))


def dense_relabel(df: DataFrame, label: str, year: str, id_col: str, out: str = "label_rank") -> DataFrame:
    """Relabel clusters 1..n in order of first appearance by (year, id) (#87)."""
    first = df.groupBy(label).agg(F.min(F.struct(year, id_col)).alias("_first"))
    ranked = row_number_global(first, ["_first", label], out).select(label, F.col(out).cast("int").alias(out))
    return df.join(ranked, label)


def rescale_labels(df: DataFrame, c: str, lo: int, hi: int, out: str) -> DataFrame:
    """Min-max rescale to [lo, hi], round half-even, int (#88)."""
    mm = df.agg(F.struct(F.min(c).alias("mn"), F.max(c).alias("mx")).alias("s")).scalar()  # one-row scalar subquery
    v = F.lit(lo) + (F.col(c) - mm["mn"]) * F.lit(hi - lo) / (mm["mx"] - mm["mn"])
    return df.withColumn(out, F.bround(v.cast("double"), 0).cast("int"))


def minmax_normalise(df: DataFrame, cols: list[str], prefix: str = "normalized_") -> DataFrame:
    """(x - min) / range per column, range 1 when constant (#89).

    All minima and maxima come from one aggregation pass, used as a scalar
    subquery (a struct value), so no join is needed to attach them.
    """
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
    mm = df.agg(F.struct(*aggs).alias("s")).scalar()
    out = df
    for c in cols:
        rng = mm[f"mx_{c}"] - mm[f"mn_{c}"]
        out = out.withColumn(f"{prefix}{c}", (F.col(c) - mm[f"mn_{c}"]) / F.when(rng != 0, rng).otherwise(F.lit(1)))
    return out


def gaps_and_islands(df: DataFrame, idx: str, flag: Column, key: list[str] | None = None) -> DataFrame:
    """Contiguous runs of ``idx`` where ``flag`` holds, as (start, end) (#91)."""
    k = key or []
    x = df.filter(flag).select(*k, idx)
    w = W.partitionBy(*k).orderBy(idx) if k else W.orderBy(idx)
    g = x.withColumn("_grp", F.col(idx) - F.row_number().over(w))
    return g.groupBy(*k, "_grp").agg(F.min(idx).alias("start"), F.max(idx).alias("end")).drop("_grp")


def topk_per_group(df: DataFrame, group, score: str, tie: str, k: int, out: str = "rank", salts: int = 16) -> DataFrame:
    """Best ``k`` rows per group by score desc, ties by ``tie`` (#92).

    Two phases, so that one huge group is never ranked in a single task:
    rows are first ranked inside (group, salt) buckets (salt = hash of the
    tie column) and only each bucket's best k survive; the final ranking
    per group then sees at most ``salts * k`` rows. Exact: a row of the
    global top k is in the top k of its own bucket.
    """
    g = [group] if isinstance(group, str) else list(group)
    order = [F.col(score).desc(), F.col(tie)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(salts)))
    first = salted.withColumn("_r0", F.row_number().over(W.partitionBy(*g, "_salt").orderBy(*order))).filter(F.col("_r0") <= k)
    w = W.partitionBy(*g).orderBy(*order)
    return first.drop("_salt", "_r0").withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= k)


def keep_first_dedup(df: DataFrame, keys: list[str], order: list, salts: int = 16) -> DataFrame:
    """drop_duplicates(keep='first') with an explicit order (#93).

    Two phases, like the top-k: the first row is taken inside (key, salt)
    buckets (salt = hash of the whole row), then among the at most ``salts``
    bucket winners of each key, so a key with very many duplicates is
    spread over many tasks. Any sort order (asc/desc, nulls) is accepted.
    """
    ords = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    first = salted.withColumn("_r0", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*ords))).filter(F.col("_r0") == 1)
    w = W.partitionBy(*keys).orderBy(*ords)
    return first.drop("_salt", "_r0").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def ecdf(df: DataFrame, group: str, v: str) -> DataFrame:
    """Empirical CDF per group: distinct values with F(v) = share of values <= v (#94).

    Values are numbered globally in (group, value) order with the
    distributed numbering; for a value, F = (last position of its tie block
    - positions before the group) / group size. No window holds a whole group.
    """
    x = df.select(group, v).filter(F.col(v).isNotNull())
    rn = row_number_global(x, [group, v], "_rn")
    ties = rn.groupBy(group, v).agg(F.max("_rn").alias("_last"))
    base = rn.groupBy(group).agg((F.min("_rn") - 1).alias("_base"), F.count(F.lit(1)).alias("_n"))
    return ties.join(base, group).select(group, v, ((F.col("_last") - F.col("_base")) / F.col("_n")).alias("F"))


def local_peaks(df: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """First and second differences and local maxima along x per series (#95)."""
    w = W.partitionBy(series).orderBy(x)
    prev, nxt = F.lag(y).over(w), F.lead(y).over(w)
    return df.select(
        series,
        x,
        y,
        (F.col(y) - prev).alias("d1"),
        (nxt - 2 * F.col(y) + prev).alias("d2"),
        F.coalesce((F.col(y) > prev) & (F.col(y) >= nxt), F.lit(False)).alias("is_peak"),
    )
