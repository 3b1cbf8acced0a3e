"""Joins of the reference, as Spark joins.

Join strategy is Catalyst's (AQE switches to broadcast at run time when a
side turns out small). Explicit ``broadcast`` is used only for dimension
tables that the optimiser measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators.windows import row_number_global

def filter_to_known(counts: DataFrame, pubs: DataFrame, key: str, pub_key: str | None = None) -> DataFrame:
    """Keep count rows whose publication exists (#43); publications are unique, so a semi-join."""
    pk = pub_key or key
    return counts.join(pubs.select(F.col(pk).alias(key)), key, "left_semi")


def left_join_count(base: DataFrame, fact: DataFrame, base_key: str, fact_key: str, out: str, faithful: bool = False) -> DataFrame:
    """Publications left-joined to a fact table, rows counted per publication (#44, #60).

    ``faithful=True`` counts joined rows with COUNT(*) (a publication without
    facts gets 1, as in the reference); the default counts matched fact rows
    (0 when none). The fact side is pre-aggregated before the join, so the
    join input is one row per key on both sides.
    """
    per = fact.groupBy(F.col(fact_key).alias(base_key)).agg(F.count(F.lit(1)).alias("_n"))
    j = base.select(base_key).join(per, base_key, "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return j.select(base_key, (F.greatest(n, F.lit(1)) if faithful else n).cast("bigint").alias(out))


def left_join_sum(pairs: DataFrame, per_member: DataFrame, key: str, member: str, value: str, out: str) -> DataFrame:
    """SUM of a per-member count over each key's members (#44, #61); NULL when no member matches."""
    return (
        pairs.join(per_member, member, "left")
        .groupBy(key)
        .agg(F.sum(value).alias(out))
    )


def multi_left_join(base: DataFrame, key: str, parts: list[tuple[DataFrame, str, object]]) -> DataFrame:
    """base LEFT JOIN each (table, column, default) on ``key`` with COALESCE (#45)."""
    out = base.select(key)
    for df, c, default in parts:
        out = out.join(df.select(key, c), key, "left").withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return out


def order_reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Compare two tables row by row in key order (#46).

    Both sides are numbered in key order (scalable global numbering, #82)
    and full-outer-joined on the number; every position whose ids differ is
    reported, including positions present on one side only (the
    reference's ``!=`` drops those).
    """
    ra = row_number_global(a.select(key), [key], "row_num").select(F.col(key).alias("a_id"), F.col("row_num").alias("a_row_num"))
    rb = row_number_global(b.select(key), [key], "row_num").select(F.col(key).alias("b_id"), F.col("row_num").alias("b_row_num"))
    j = ra.join(rb, ra.a_row_num == rb.b_row_num, "full_outer")
    return j.filter(~F.col("a_id").eqNullSafe(F.col("b_id")))


def dim_lookup(df: DataFrame, dim: DataFrame, left_key: str, dim_key: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup with defaults for misses (#49)."""
    d = dim.withColumnRenamed(dim_key, "_dk")
    j = df.join(d, df[left_key] == d["_dk"], "left").drop("_dk")
    for c, v in defaults.items():
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return j


def semi_join_nodes(dim: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Mapping rows whose node is an end of some edge (#50)."""
    ends = edges.select(F.explode(F.array("node1", "node2")).alias(key))
    return dim.join(ends, key, "left_semi")


def anti_join_leakage(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Training rows whose group occurs in the test fold are removed (#51)."""
    return train.join(test.select(group), group, "left_anti")


def fanout_join(authors: DataFrame, scores: DataFrame, pub: str, name: str, corrected: bool = False) -> DataFrame:
    """Author rows joined to publication scores (#52, #53).

    Faithful: on publication only, so each author row receives the score of
    every (publication, author) row of its publication (m x m). Corrected:
    on (publication, author).
    """
    keys = [pub, name] if corrected else [pub]
    right = scores.select(*keys, "impact_score")
    return authors.join(right, keys, "left")


def column_concat(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Add B's columns to A by key, skipping columns A already has (#54)."""
    extra = [c for c in b.columns if c not in a.columns]
    return a.join(b.select(key, *extra), key, "left")


def mask_align(df: DataFrame, mask: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose (possibly missing) mask flag is true (#55)."""
    return df.join(mask.select(key, flag), key, "left").filter(F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def residual_join(preds: DataFrame, pubs: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """Residual actual - predicted joined to publications (#59, #151)."""
    r = preds.select(F.col(key), (F.col(actual) - F.col(predicted)).alias("Diff"))
    return pubs.join(r, key, "left")
