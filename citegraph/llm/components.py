"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.store import write_once

MAX_ROUNDS = 60
#: edges of a file: tables of the rounds are written by as many tasks as their edges call for
FILE_EDGES = 200_000


def _star(edges: DataFrame, large: bool, files: int) -> DataFrame:
    """Connect the neighbours of every node u to the smallest of them and u.

    large: the neighbours larger than u; small: the smaller ones, and u itself.
    The minima are written before they are joined, so that both sides of the
    join are plain shuffles and a hub's rows can be split.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(write_once(low.coalesce(files), "star"), "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node of an edge (u, v) of longs."""
    edges = write_once(edges.select("u", "v").filter("u != v").distinct(), "edges")
    # a node with several smaller neighbours keeps one edge, to the smallest; the others are tied to that
    files = max(1, -(-edges.count() // FILE_EDGES))
    edges = write_once(_star(edges, False, files).coalesce(files), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = write_once(_star(_star(edges, True, files), False, files).coalesce(files), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
