"""Consensus clustering and model selection (#58, #99, #114, #127-#148).

Scale design (as in the reference): the data-sized step is k-means of the
items to ``n_centroids`` centroids with Spark ML (#127); everything
consensus-related then runs on the centroid table, whose size is the
k-means parameter, not the data size.

* subsampling (#128) is a hash ranking per permutation (reproducible under
  task retry);
* clustering every (permutation, k, restart) (#130, #131) is one task for each
  permutation while a subsample fits one; beyond that one job a round over all
  of them: items are assigned to their nearest centre or medoid by a join and
  a minimum, centres are updated by an aggregate;
* spectral (#132), modularity (#133) and affinity (#134) clustering work on
  the distances of each subsample's items;
* the co-association matrix (#135) compares two items' bits over all
  permutations at once; items meet in a grid of blocks;
* PAC, CDF area, histogram, bimodality, dip (#136-#140) are aggregations
  per k; the dip (``operators/dip.py``) runs per k on the (value, count) table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from citegraph.operators.dip import dip_test  # noqa: F401

# Fixed values of the reference: the k values of the consensus run and its defaults.
REFERENCE_K_RANGE = [2, 4, 6, 8, 10, 12, 14, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 170, 180, 190, 200]
PAC_LOW, PAC_HIGH = 0.1, 0.9


# ----------------------------------------------------------- vectors (long)


def to_long(v: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """(id, vec array) -> (id, dim, x)."""
    return v.select(id_col, F.posexplode(vec).alias("dim", "x"))


def normalise_rows(v: DataFrame, vec: str = "vec") -> DataFrame:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return v.withColumn(vec, F.transform(vec, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0))))


# ------------------------------------------------------------- distances

METRICS = ("cosine", "euclidean", "sqeuclidean", "correlation", "eta")


def distance(a: str | Column, b: str | Column, metric: str) -> Column:
    """Distance of two double arrays.

    'cosine', 'euclidean', 'sqeuclidean', 'correlation' (negative correlations
    set to 0 before 1 - r, as the reference) or 'eta' (1 - eta squared).
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + t)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    square = total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))
    n = F.size(a).cast("double")
    if metric == "cosine":
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(F.lit(1.0))
    if metric == "euclidean":
        return F.sqrt(square)
    if metric == "sqeuclidean":
        return square
    if metric == "correlation":
        ma, mb = total(a) / n, total(b) / n
        ca, cb = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
        norm = F.sqrt(dot(ca, ca) * dot(cb, cb))
        return F.when(norm > 0, 1 - F.greatest(dot(ca, cb) / norm, F.lit(0.0))).otherwise(F.lit(1.0))
    if metric == "eta":
        # within-pair over total variation; a pair's own variation is half its squared difference
        mean = (total(a) + total(b)) / (2 * n)
        dev = lambda c: total(F.transform(c, lambda x: (x - mean) * (x - mean)))
        spread = dev(a) + dev(b)
        return F.when(spread > 0, square / 2 / spread).otherwise(F.lit(0.0))
    raise ValueError(f"unknown distance {metric}; one of {METRICS}")


# -------------------------------------------------------------- #127, #77


def _start_centres(x: DataFrame, k: int, restarts: int, seed: int):
    """(restart, cluster, unit vector) as one array: k-means|| for the first restart, distinct points by hash for the others."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from citegraph.functions.columns import stable_hash

    first = np.array(KMeans(k=k, distanceMeasure="cosine", maxIter=0, seed=seed, featuresCol="f").fit(x.select(array_to_vector("vec").alias("f"))).clusterCenters())
    k = len(first)  # fewer distinct points than asked for
    out = np.zeros((restarts, k, len(first[0])))
    out[0] = first
    few = x.coalesce(2 * x.sparkSession.sparkContext.defaultParallelism)
    for r in range(1, restarts):  # k rows of every task, a parameter
        rows = few.orderBy(stable_hash(F.col("id").cast("string"), seed + r), "id").limit(k).select("vec").collect()
        out[r, : len(rows)] = [row["vec"] for row in rows]
        out[r, len(rows) :] = first[len(rows) :]
    norm = np.linalg.norm(out, axis=2, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


#: numbers of a block of points, at most (one point at least)
BLOCK_VALUES = 1 << 17


def _blocks(x: DataFrame, dim: int) -> DataFrame:
    """(vecs): the vectors of ``x`` in blocks, the bytes of their doubles as one value, written in a file for each task that runs at once."""
    import numpy as np
    import pyarrow as pa

    from citegraph.session import cut_lineage

    tasks = x.sparkSession.sparkContext.defaultParallelism
    per = max(1, min(BLOCK_VALUES // dim, -(-x.count() // (4 * tasks))))

    def run(batches):
        for batch in batches:
            v = np.array(batch.column("vec").flatten(), dtype=float).reshape(-1, dim)
            for at in range(0, len(v), per):
                yield pa.RecordBatch.from_arrays([pa.array([v[at : at + per].tobytes()], pa.binary())], names=["vecs"])

    return cut_lineage(x.select("vec").mapInArrow(run, "vecs binary").repartition(tasks))


def _marks(v):
    """Two 32-bit numbers of every row, by a hash of its doubles; their sums tell sets of rows apart."""
    import numpy as np

    odd = np.random.default_rng(7).integers(1, 1 << 62, v.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (v.view(np.uint64) * odd).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)


def _changed(seen, told):
    """Clusters with members that are not those of ``told``: rows (n, sum, sum) of ``_marks``."""
    return (seen != told).any(1) & (seen[:, 0] > 0)


def _lloyd_round(blocks: DataFrame, centres, told) -> list:
    """Rows (restart, seen, cost, sums): one scan that assigns every point under all restarts and adds up the members.

    ``seen`` holds (n, sum, sum) for each cluster: members and the sums of
    their ``_marks``. ``sums`` holds the vectors' sums of the ``_changed``
    clusters only: the others have the members they were ``told`` with.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((centres, told))  # restarts x k vectors, parameters
    kind = "restart int, seen binary, cost double, sums binary"
    names = ["restart", "seen", "cost", "sums"]

    def run(batches):
        c = shared.value[0]
        restarts, k, dim = c.shape
        total, seen, cost = np.zeros(c.shape), np.zeros((restarts, k, 3), np.int64), np.zeros(restarts)
        small = np.uint16 if k <= 1 << 16 else np.int64
        for batch in batches:
            for value in batch.column("vecs"):
                v = np.frombuffer(value.as_buffer()).reshape(-1, dim)
                marks = np.stack([np.ones(len(v), np.int64), *_marks(v)], 1)
                for r in range(restarts):
                    dots = v @ c[r].T
                    best = dots.argmax(1)
                    held = np.bincount(best, minlength=k)
                    has = np.flatnonzero(held)
                    first = (np.cumsum(held) - held)[has]
                    order = np.argsort(best.astype(small), kind="stable")
                    total[r, has] += np.add.reduceat(v[order], first, axis=0)
                    seen[r, has] += np.add.reduceat(marks[order], first, axis=0)
                    cost[r] += (1 - dots[np.arange(len(v)), best]).sum()
        for r in range(restarts):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([seen[r].tobytes()], pa.binary()), pa.array([cost[r]]), pa.array([total[r].tobytes()], pa.binary())], names=names)

    def add(table):
        told = shared.value[1][table.column("restart")[0].as_py()]
        seen = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("seen")).reshape(told.shape)
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums")).reshape(len(told), -1)
        new = total[_changed(seen, told)].tobytes()
        return pa.table([table.column("restart")[:1], pa.array([seen.tobytes()], pa.binary()), pa.array([pc.sum(table.column("cost")).as_py()]), pa.array([new], pa.binary())], names=names)

    summed = blocks.mapInArrow(run, kind).repartition(min(len(centres), sc.defaultParallelism), "restart")
    got = summed.groupBy("restart").applyInArrow(add, kind).collect()
    shared.destroy()
    return got


def kmeans_cosine(v: DataFrame, k: int, restarts: int = 20, max_iter: int = 1000, seed: int = 42, id_col: str = "id", vec: str = "vec", tol: float = 1e-4):
    """Spherical k-means with cosine distance; the restart with the lowest cost is kept (#127).

    All restarts advance in the same scan of a round: tasks add up the members
    of restarts x k centres, the driver gets the sums that changed (parameters,
    not data) and moves the centres. The first restart starts where Spark ML's
    k-means would, so the cost kept is not above that of its fit. Rounds end
    when no centre moves by ``tol``, or after ``max_iter``; a centre without
    members keeps its place.

    Returns (assignments (id, cluster), centroids (cluster, centroid)). The
    centroid is the mean of the member vectors (#77), as the reference
    recomputes it.
    """
    import numpy as np
    import pyarrow as pa

    from citegraph.operators.aggregates import vector_mean
    from citegraph.session import cut_lineage, discard

    raw = v.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    x = cut_lineage(normalise_rows(raw, "vec"))
    centres = _start_centres(x, k, restarts, seed)
    blocks = _blocks(x, centres.shape[2])
    cost = np.full(len(centres), np.inf)
    best, open_ = centres.copy(), np.arange(len(centres))
    total, told = np.zeros(centres.shape), np.full((*centres.shape[:2], 3), -1)
    for _ in range(max_iter):
        now, moved = np.zeros(len(open_)), centres[open_]
        for row in _lloyd_round(blocks, centres[open_], told[open_]):
            i, r = row["restart"], open_[row["restart"]]
            seen = np.frombuffer(row["seen"], np.int64).reshape(-1, 3)
            new = _changed(seen, told[r])
            told[r, new], total[r, new] = seen[new], np.frombuffer(row["sums"]).reshape(-1, centres.shape[2])
            norm = np.linalg.norm(total[r], axis=1)
            has = (seen[:, 0] > 0) & (norm > 0)
            now[i], moved[i, has] = row["cost"], total[r, has] / norm[has, None]
        better = now < cost[open_]
        cost[open_[better]], best[open_[better]] = now[better], centres[open_[better]]
        shift = np.linalg.norm(moved - centres[open_], axis=2).max(1)
        centres[open_] = moved
        open_ = open_[shift > tol]
        if not len(open_):
            break
    discard(blocks)
    kept = v.sparkSession.sparkContext.broadcast(best[int(np.argmin(cost))])

    def nearest(batches):
        c = kept.value
        for batch in batches:
            vectors = np.array(batch.column("vec").flatten()).reshape(-1, c.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((vectors @ c.T).argmax(1), pa.int32())], names=["id", "cluster"])

    kind = raw.schema["id"].dataType.simpleString()
    assign = x.select("id", "vec").mapInArrow(nearest, f"id {kind}, cluster int").select(F.col("id").alias(id_col), "cluster")
    members = assign.join(raw.withColumnRenamed("id", id_col), id_col)
    return assign, vector_mean(members, "cluster", "vec", "centroid")


# ----------------------------------------------------------------- #58, #142


def nearest_centroid(points: DataFrame, centroids: DataFrame, id_col: str = "id", vec: str = "vec", block_values: int = 4_000_000) -> DataFrame:
    """Every point -> the centroid at the smallest cosine distance (#58), ties to the smaller cluster.

    The centroids are packed into blocks of at most ``block_values`` numbers
    (one centroid at least), one array row each. A point meets every block
    through an equi-join on the block number and scans it inside one
    expression; the minimum over the blocks wins. A single block, whose size
    is bounded by its definition, is broadcast.
    """
    c = normalise_rows(centroids.select("cluster", F.col("centroid").alias("vec")))
    size = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    per = max(1, block_values // max(1, size.d or 1))
    blocks = max(1, -(-size.n // per))
    block = F.pmod(F.xxhash64("cluster"), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")
    packed = c.groupBy(block.alias("_b")).agg(F.collect_list(F.struct("cluster", "vec")).alias("_cs"))
    p = normalise_rows(points.select(id_col, F.col(vec).cast("array<double>").alias("vec")))
    p = p.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    best = F.array_min(F.transform("_cs", lambda cc: F.struct((F.lit(1.0) - dot(F.col("vec"), cc["vec"])).alias("dist"), cc["cluster"].alias("cluster"))))
    scored = p.join(F.broadcast(packed) if blocks == 1 else packed, "_b").select(id_col, best.alias("_best"))
    if blocks > 1:
        scored = scored.groupBy(id_col).agg(F.min("_best").alias("_best"))
    return scored.select(id_col, F.col("_best.cluster").alias("centroid"), F.col("_best.dist").alias("dist"))


def assign_points(points: DataFrame, centroids: DataFrame, labels: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Final cluster of every item = label of its nearest centroid (#142).

    Every centroid must have a label: a missing one raises when the row is read.
    """
    nc = nearest_centroid(points, centroids, id_col, vec)
    got = nc.join(labels.select(F.col("cluster").alias("centroid"), F.col("final_cluster").alias("_f")), "centroid", "left")
    final = F.when(F.col("_f").isNull(), F.raise_error(F.concat(F.lit("no label for centroid "), F.col("centroid").cast("string")))).otherwise(F.col("_f"))
    return got.withColumn("final_cluster", final.cast(labels.schema["final_cluster"].dataType)).drop("_f")


# ------------------------------------------------------------------- #128


def subsample_items(items: DataFrame, perms: int, p: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """round(n·p) items per permutation, ranked by a hash of (id, perm, seed) (#128).

    Output (perm, id). A window partitioned by permutation ranks the items;
    one permutation holds the item table once (the centroid count).
    """
    n = items.count()
    m = int(round(n * p))
    x = items.select(id_col).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    from citegraph.functions.columns import stable_hash

    w = W.partitionBy("perm").orderBy(stable_hash(F.concat_ws(":", F.col(id_col).cast("string"), F.col("perm").cast("string")), seed), F.col(id_col))
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m).select("perm", id_col)


# ------------------------------------------------------------------- #129


def centre_scale(sv: DataFrame, group: str = "perm", id_col: str = "id", vec: str = "vec", centre: bool = True, scale: bool = True) -> DataFrame:
    """Subtract the column means of each group's vectors, then divide by the largest |value| (#129)."""
    lng = sv.select(group, id_col, F.posexplode(vec).alias("dim", "x"))
    if centre:
        mu = lng.groupBy(group, "dim").agg(F.avg("x").alias("_mu"))
        lng = lng.join(mu, [group, "dim"]).withColumn("x", F.col("x") - F.col("_mu")).drop("_mu")
    if scale:
        mx = lng.groupBy(group).agg(F.max(F.abs("x")).alias("_mx"))
        lng = lng.join(mx, group).withColumn("x", F.col("x") / F.when(F.col("_mx") > 0, F.col("_mx")).otherwise(1.0)).drop("_mx")
    return lng.groupBy(group, id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias(vec)
    )


# ------------------------------------------------------------ #130, #131

#: one clustering run: a permutation's subsample, a k, a restart
RUN = ["perm", "k", "rep"]


def _runs(sv: DataFrame, ks: list[int], reps: int, id_col: str) -> DataFrame:
    """Items of every run; runs whose k exceeds their number of items do not exist."""
    n = sv.groupBy("perm").agg(F.count(F.lit(1)).alias("_n"))
    grid = n.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter("k <= _n").drop("_n")
    grid = grid.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return sv.select("perm", id_col).join(grid, "perm")


def _starts(runs: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The k first items of every run by a hash of (item, run): (run, cluster, item)."""
    from citegraph.functions.columns import stable_hash

    key = F.concat_ws(":", F.col(id_col).cast("string"), *[F.col(c).cast("string") for c in RUN])
    w = W.partitionBy(*RUN).orderBy(stable_hash(key, seed), F.col(id_col))
    return runs.withColumn("cluster", F.row_number().over(w) - 1).filter("cluster < k")


def _nearest(pairs: DataFrame, id_col: str) -> DataFrame:
    best = F.min(F.struct("dist", "cluster")).alias("_b")
    return pairs.groupBy(*RUN, id_col).agg(best).select(*RUN, id_col, "_b.cluster", "_b.dist")


def distances_to(v, c, metric: str):
    """``distance`` of every row of the matrix ``v`` to every row of ``c``."""
    import numpy as np

    def unit(x):
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    if metric == "cosine":
        return 1 - unit(v) @ unit(c).T
    if metric == "correlation":
        centred = lambda x: unit(x - x.mean(1, keepdims=True))
        return 1 - np.maximum(centred(v) @ centred(c).T, 0)
    square = np.stack([((v - row) ** 2).sum(1) for row in c], 1)
    if metric == "euclidean":
        return np.sqrt(square)
    if metric == "sqeuclidean":
        return square
    if metric == "eta":
        total = v.sum(1)[:, None] + c.sum(1)[None, :]
        spread = (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - total * total / (2 * v.shape[1])
        return np.where(spread > 0, square / 2 / np.where(spread > 0, spread, 1), 0.0)
    raise ValueError(f"unknown distance {metric}; one of {METRICS}")


#: distances that a task holds at a time
STEP_VALUES = 2_000_000


def _settled_runs(v, apart, firsts, metric: str, max_iter: int):
    """(cost, cluster of every item) of each run from its items ``firsts``, all of one k; ``apart`` are the items' distances for 'pam', else None."""
    import numpy as np

    at = np.array(firsts)
    k, n, out = at.shape[1], len(v), []
    per = max(1, STEP_VALUES // (n * k))
    for lo in range(0, len(at), per):
        out += _settled_step(v, apart, at[lo : lo + per], metric, max_iter)
    return out


def _settled_step(v, apart, at, metric: str, max_iter: int):
    """``_settled_runs`` of as many runs as advance together."""
    import numpy as np

    (runs, k), n = at.shape, len(v)
    at, centres = at.copy(), v[at]
    before, cost = np.full((runs, n), -1), np.zeros(runs)
    # 'cosine': unit vectors once, the centres of all runs in one product
    unit = lambda x: x / np.where((norm := np.sqrt((x * x).sum(1, keepdims=True))) > 0, norm, 1)
    u, columns = unit(v) if metric == "cosine" else None, None if apart is None else apart.T.copy()
    open_ = np.arange(runs)
    for _ in range(max_iter):
        if apart is not None:
            d = columns[at[open_]]
        elif metric == "cosine":
            d = (1 - unit(centres[open_].reshape(-1, v.shape[1])) @ u.T).reshape(len(open_), k, n)
        else:
            d = np.stack([distances_to(v, centres[r], metric).T for r in open_])
        near = d.argmin(1)
        cost[open_] = np.take_along_axis(d, near[:, None], 1)[:, 0].sum(1)
        moved = (near != before[open_]).any(1)
        open_, near = open_[moved], near[moved]
        if not len(open_):
            break
        before[open_] = near
        # items of one run's cluster after another; a centre without members keeps its place
        key = (near + np.arange(len(open_))[:, None] * k).ravel()
        order = np.argsort(key, kind="stable")
        held = np.bincount(key, minlength=len(open_) * k)
        has = np.flatnonzero(held)
        start = (np.cumsum(held) - held)[has]
        mine = order % n
        if apart is None:
            centres[open_[has // k], has % k] = np.add.reduceat(v[mine], start, axis=0) / held[has, None]
        else:
            for c, lo, size in zip(has, start, held[has]):
                own = mine[lo : lo + size]
                at[open_[c // k], c % k] = own[apart[np.ix_(own, own)].sum(1).argmin()] if size > 1 else own[0]
    return [(float(c), near) for c, near in zip(cost, before)]


def _clusters_in_tasks(items: DataFrame, ks: list[int], algo: str, metric: str, max_iter: int, reps: int, seed: int, id_col: str) -> DataFrame:
    """``consensus_cluster`` with all runs of a subsample in one task; items: (perm, id, a)."""
    import hashlib

    import numpy as np
    import pandas as pd

    def run(rows):
        rows = rows.sort_values(id_col, ignore_index=True)
        v = np.array(rows["a"].tolist(), dtype=float)
        apart, names, perm = distances_to(v, v, metric) if algo == "pam" else None, rows["_name"].tolist(), rows["perm"][0]
        if apart is not None:
            np.fill_diagonal(apart, 0.0)
        # the order of ``_starts``
        drawn = lambda key: int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16)
        out = []
        for k in ks:
            if not 1 <= k <= len(v):
                continue
            firsts = [sorted(range(len(v)), key=lambda i: (drawn(f"{names[i]}:{perm}:{k}:{rep}"), i))[:k] for rep in range(reps)]
            best = min(_settled_runs(v, apart, firsts, metric, max_iter), key=lambda run: run[0])
            out.append(pd.DataFrame({"perm": rows["perm"], "k": k, id_col: rows[id_col], "cluster": best[1]}))
        return pd.concat(out) if out else pd.DataFrame({"perm": [], "k": [], id_col: [], "cluster": []})

    kind = lambda c: items.schema[c].dataType.simpleString()
    x = items.select("perm", id_col, "a", F.col(id_col).cast("string").alias("_name"))
    # few bytes mean long work: the number of tasks is set, not left to the rows' bytes
    x = x.repartition(4 * items.sparkSession.sparkContext.defaultParallelism, "perm")
    return x.groupBy("perm").applyInPandas(run, f"perm {kind('perm')}, k int, {id_col} {kind(id_col)}, cluster int")


def consensus_cluster(
    sv: DataFrame,
    ks: list[int],
    algo: str = "kmeans",
    metric: str = "cosine",
    max_iter: int = 1000,
    reps: int = 20,
    seed: int = 42,
    id_col: str = "id",
    vec: str = "vec",
    task_values: int = 20_000_000,
) -> DataFrame:
    """Cluster every permutation's subsample for every k: L(perm, k, id, cluster).

    algo 'kmeans' (#130): centres are means of their members; 'pam' (#131):
    centres are the members with the smallest distance to the others;
    'spectral' (#132), 'modularity' (#133) and 'affinity' (#134): see
    ``spectral_cluster``, ``modularity_cluster`` and ``affinity_cluster``.
    Where no subsample has more than ``task_values`` numbers (its vectors, with
    'pam' its distances), each is one task's, which does its runs one after the
    other; beyond, all runs (permutation, k, restart) advance in the same jobs,
    each round written once. A run is settled when its assignment repeats, all stop when
    every run is settled or after ``max_iter`` rounds. The restart with the
    lowest cost is kept, the first of equals. A centre without members keeps
    its place. Unknown algorithms and metrics raise.
    """
    from citegraph.session import cut_lineage, discard

    if algo == "spectral":
        return spectral_cluster(sv, ks, metric, seed=seed, id_col=id_col, vec=vec)
    if algo == "modularity":
        return modularity_cluster(sv, metric, max_iter, id_col, vec)
    if algo == "affinity":
        return affinity_cluster(affinity_exemplars(sv, ks, metric, id_col, vec), id_col)
    if algo not in ("kmeans", "pam"):
        raise ValueError(f"unknown algorithm {algo}")
    distance("a", "a", metric)
    items = sv.select("perm", F.col(id_col), F.col(vec).cast("array<double>").alias("a"))
    size = items.groupBy("perm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("a")).alias("v")).agg(F.max("n").alias("n"), F.max("v").alias("v")).first()
    if max(size["v"] or 0, (size["n"] or 0) ** 2 if algo == "pam" else 0) <= task_values:
        return _clusters_in_tasks(items, ks, algo, metric, max_iter, reps, seed, id_col)
    # cosine: unit vectors on both sides, so that a distance is one dot product
    unit = lambda v: normalise_rows(v.withColumn("u", F.col("a")), "u") if metric == "cosine" else v.withColumn("u", F.col("a"))
    items = cut_lineage(unit(items))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    apart = (lambda x, y: 1 - dot(x, y)) if metric == "cosine" else (lambda x, y: distance(x, y, metric))
    runs = cut_lineage(_runs(items, ks, reps, id_col))
    centres = _starts(runs, id_col, seed)
    whole = items.groupBy("perm", id_col).agg(F.first("a").alias("b"))
    if algo == "kmeans":
        centres = centres.join(whole, ["perm", id_col]).select(*RUN, "cluster", "b")
    else:
        vectors = items.dropDuplicates([id_col]).select(F.col(id_col).alias("i"), "a")
        half = cut_lineage(pair_distance(vectors, metric, "i", "a"))
        own = vectors.select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist"))
        table = cut_lineage(half.union(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")).union(own))
        centres = centres.select(*RUN, "cluster", F.col(id_col).alias("j"))
    before, labels = None, None
    for _ in range(max_iter):
        if algo == "kmeans":
            # one row for each (run, item): a run's centres lie packed in one row
            packed = unit(centres.select(*RUN, "cluster", F.col("b").alias("a"))).groupBy(*RUN).agg(F.collect_list(F.struct("cluster", "u")).alias("cs"))
            met = runs.join(items.select("perm", id_col, "u"), ["perm", id_col]).join(packed, RUN)
            best = F.array_min(F.transform("cs", lambda c: F.struct(apart(F.col("u"), c["u"]).alias("dist"), c["cluster"].alias("cluster"))))
            near = met.select(*RUN, id_col, best.alias("_b")).select(*RUN, id_col, "_b.cluster", "_b.dist")
        else:
            near = _nearest(runs.join(centres, RUN).join(table.withColumnRenamed("i", id_col), [id_col, "j"]).select(*RUN, id_col, "cluster", "dist"), id_col)
        if labels is not None:
            discard(labels)
        labels = cut_lineage(near)
        now = labels.agg(F.bit_xor(F.xxhash64(*RUN, id_col, "cluster"))).first()[0]
        if now == before:
            break
        before = now
        if algo == "kmeans":
            from pyspark.ml.functions import array_to_vector, vector_to_array
            from pyspark.ml.stat import Summarizer

            mean = labels.join(items, ["perm", id_col]).groupBy(*RUN, "cluster").agg(Summarizer.mean(array_to_vector(F.col("a"))).alias("m"))
            moved = mean.select(*RUN, "cluster", vector_to_array("m").alias("n"))
            centres = cut_lineage(centres.join(moved, [*RUN, "cluster"], "left").select(*RUN, "cluster", F.coalesce("n", "b").alias("b")))
        else:
            left = labels.select(*RUN, "cluster", F.col(id_col).alias("i"))
            right = labels.select(*RUN, "cluster", F.col(id_col).alias("j"))
            cost = left.join(right, [*RUN, "cluster"]).join(table, ["i", "j"]).groupBy(*RUN, "cluster", "i").agg(F.sum("dist").alias("c"))
            moved = cost.groupBy(*RUN, "cluster").agg(F.min(F.struct("c", "i")).alias("_m")).select(*RUN, "cluster", F.col("_m.i").alias("n"))
            centres = cut_lineage(centres.join(moved, [*RUN, "cluster"], "left").select(*RUN, "cluster", F.coalesce("n", "j").alias("j")))
    best = labels.groupBy(*RUN).agg(F.sum("dist").alias("c")).groupBy("perm", "k").agg(F.min(F.struct("c", "rep")).alias("_m"))
    kept = best.select("perm", "k", F.col("_m.rep").alias("rep"))
    return labels.join(kept, RUN).select("perm", "k", id_col, "cluster")


# ------------------------------------------------------------ #132, #133


def subsample_distances(sv: DataFrame, metric: str, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """(perm, i, j, dist): distances of the items of each subsample, every pair once.

    Distances come from one table of all items' pairs; a subsample takes the
    pairs whose both items it holds.
    """
    from citegraph.session import cut_lineage

    vectors = sv.dropDuplicates([id_col]).select(F.col(id_col).alias("id"), vec)
    table = cut_lineage(pair_distance(vectors, metric, "id", vec))
    has = lambda c: sv.select("perm", F.col(id_col).alias(c))
    return table.join(has("i"), "i").join(has("j"), ["perm", "j"]).select("perm", "i", "j", "dist")


def scaled_affinity(dist: DataFrame, neighbour: int = 7) -> DataFrame:
    """(perm, i, j, w) with w = exp(-d^2 / (s_i s_j)), s the distance to an item's ``neighbour``-th nearest one (#132).

    An item with fewer neighbours takes its farthest; where a scale is 0, equal
    items have 1 and others 0.
    """
    both = dist.select("perm", "i", "j", "dist").union(dist.select("perm", F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    w = W.partitionBy("perm", "i").orderBy("dist", "j")
    scale = both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= neighbour).groupBy("perm", "i").agg(F.max("dist").alias("s"))
    s = lambda c: scale.select("perm", F.col("i").alias(c), F.col("s").alias(f"s{c}"))
    x = dist.join(s("i"), ["perm", "i"]).join(s("j"), ["perm", "j"])
    unit = F.col("si") * F.col("sj")
    value = F.when(unit > 0, F.exp(-F.col("dist") * F.col("dist") / unit)).otherwise((F.col("dist") == 0).cast("double"))
    return x.select("perm", "i", "j", value.alias("w"))


def spectral_cluster(sv: DataFrame, ks: list[int], metric: str = "cosine", neighbour: int = 7, max_iter: int = 20, seed: int = 42, parallelism: int = 4, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """L(perm, k, id, cluster) by power iteration clustering of the locally scaled affinity (#132).

    Each (permutation, k) is one ``PowerIterationClustering`` job, a few of them
    at a time; k above a subsample's items is left out. Items without any
    affinity join cluster 0. An unknown metric raises.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import PowerIterationClustering

    from citegraph.session import cut_lineage

    distance("a", "a", metric)
    items = cut_lineage(sv.select("perm", F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")))
    affinity = cut_lineage(scaled_affinity(cut_lineage(subsample_distances(items, metric)), neighbour).filter("w > 0"))
    # the library wants ids that are longs: places in the order of the items
    from citegraph.operators.windows import row_number_global

    place = cut_lineage(row_number_global(items.select("id").distinct(), ["id"], "n"))
    number = lambda c, out: place.select(F.col("id").alias(c), F.col("n").alias(out))
    numbered = cut_lineage(affinity.join(number("i", "src"), "i").join(number("j", "dst"), "j").select("perm", "src", "dst", "w"))
    sizes = {r["perm"]: r["n"] for r in items.groupBy("perm").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a permutation

    def one(run):
        perm, k = run
        part = numbered.filter(F.col("perm") == perm).drop("perm")
        pic = PowerIterationClustering(k=k, maxIter=max_iter, initMode="random", srcCol="src", dstCol="dst", weightCol="w")
        got = pic.assignClusters(part).select(F.col("id").alias("n"), "cluster")
        own = items.filter(F.col("perm") == perm).join(place, "id").join(got, "n", "left")
        return cut_lineage(own.select("perm", F.lit(int(k)).alias("k"), F.col("id").alias(id_col), F.coalesce("cluster", F.lit(0)).alias("cluster")))

    runs = [(p, k) for p in sorted(sizes) for k in ks if k <= sizes[p]]
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, runs))
    out = None
    for part in parts:
        out = part if out is None else out.union(part)
    return out if out is not None else items.limit(0).select("perm", F.lit(0).alias("k"), F.col("id").alias(id_col), F.lit(0).alias("cluster"))


def similarity(dist: DataFrame, metric: str) -> DataFrame:
    """Distances as weights of a similarity graph: 1 / (1 + d) for euclidean ones, else 1 - d, 0 at least (#133)."""
    w = 1 / (1 + F.col("dist")) if metric in ("euclidean", "sqeuclidean") else F.greatest(1 - F.col("dist"), F.lit(0.0))
    return dist.select("perm", "i", "j", w.alias("w"))


def modularity_cluster(sv: DataFrame, metric: str = "correlation", max_iter: int = 1000, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """L(perm, k, id, cluster): modularity communities of every subsample's similarity graph (#133).

    The method finds the number of clusters itself; ``k`` is the number found,
    clusters are numbered from 0 in the order of their smallest item.
    """
    from citegraph.operators.communities import modularity_communities
    from citegraph.session import cut_lineage

    graph = similarity(subsample_distances(sv, metric, id_col, vec), metric)
    found = cut_lineage(modularity_communities(graph, "perm", max_rounds=max_iter))
    names = found.select("perm", "community").distinct()
    names = names.withColumn("cluster", F.row_number().over(W.partitionBy("perm").orderBy("community")) - 1)
    k = names.groupBy("perm").agg(F.count(F.lit(1)).cast("int").alias("k"))
    return found.join(names, ["perm", "community"]).join(k, "perm").select("perm", "k", F.col("node").alias(id_col), F.col("cluster").cast("int").alias("cluster"))


def affinity_exemplars(sv: DataFrame, ks: list[int], metric: str = "cosine", id_col: str = "id", vec: str = "vec", **search) -> DataFrame:
    """(perm, k, i, exemplar, preference, n_clusters, exact): affinity propagation of every subsample for every k (#134).

    A similarity is the negative distance; see ``affinity.affinity_clusters``.
    """
    from citegraph.operators.affinity import affinity_clusters
    from citegraph.session import cut_lineage

    half = cut_lineage(subsample_distances(sv, metric, id_col, vec).select("perm", "i", "j", (-F.col("dist")).alias("s")))
    both = half.unionByName(half.select("perm", F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    return affinity_clusters(both, ks, "perm", **search)


def affinity_cluster(exemplars: DataFrame, id_col: str = "id") -> DataFrame:
    """L(perm, k, id, cluster): clusters numbered from 0 in the order of their exemplars (#134)."""
    names = exemplars.select("perm", "k", "exemplar").distinct()
    names = names.withColumn("cluster", F.row_number().over(W.partitionBy("perm", "k").orderBy("exemplar")) - 1)
    return exemplars.join(names, ["perm", "k", "exemplar"]).select("perm", "k", F.col("i").alias(id_col), "cluster")


# ------------------------------------------------------------------- #135


def _words(rows: DataFrame, by: list[str], width: int, planes: list[Column], out: str) -> DataFrame:
    """(by, out): for every word of 64 permutations the OR of each plane, one array of longs."""
    words = rows.groupBy(*by, F.floor(F.col("perm") / 64).cast("int").alias("_w")).agg(*[F.bit_or(p).alias(f"_p{i}") for i, p in enumerate(planes)])
    packed = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_w", F.array(*[f"_p{i}" for i in range(len(planes))])))).alias("_m"))
    none = F.array(*[F.lit(0).cast("long")] * len(planes))
    return packed.select(*by, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.coalesce(F.element_at("_m", w), none))).alias(out))


def coassociation_matrix(labels: DataFrame, sampled: DataFrame, ks: list[int], id_col: str = "id", rows_per_block: int | None = None) -> DataFrame:
    """consensus(k, i, j) = #perms with i, j in one cluster / #perms with both sampled, i < j (#135).

    labels: (perm, k, id, cluster); sampled: (perm, id); permutations count
    from 0. An item has a bit for each permutation that holds it, and for each
    k a bit plane for each binary digit of its cluster; two items are together
    where all planes agree, so a pair is counted by a few operations on words
    of 64 permutations. Items meet in a grid of blocks, each pair once; there
    are no rows for a pair's permutations. Pairs of all items that occur, null
    where they were never sampled together.
    """
    from citegraph.session import cut_lineage

    bit = F.expr("shiftleft(1L, CAST(perm % 64 AS INT))")
    top = sampled.agg(F.max("perm").alias("p")).first()["p"]
    if top is None:
        return sampled.select(F.lit(0).alias("k"), F.col(id_col).alias("i"), F.col(id_col).alias("j"), F.lit(None).cast("double").alias("consensus")).limit(0)
    width = int(top) // 64 + 1
    digits = max(1, int(labels.agg(F.coalesce(F.max("cluster"), F.lit(0))).first()[0]).bit_length())
    mine = _words(sampled.select("perm", F.col(id_col).alias("id")).distinct(), ["id"], width, [bit], "held")
    planes = [bit, *[F.when(F.expr(f"(cluster & {1 << p}) != 0"), bit).otherwise(F.lit(0).cast("long")) for p in range(digits)]]
    own = _words(labels.select("perm", "k", F.col(id_col).alias("id"), F.col("cluster").cast("int").alias("cluster")), ["k", "id"], width, planes, "bits")
    grid = mine.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    zero = F.array_repeat(F.lit(0).cast("long"), width * (digits + 1))
    table = cut_lineage(grid.join(own, ["k", "id"], "left").select("k", "id", "held", F.coalesce("bits", zero).alias("bits")))
    met = block_pairs(table, "id", rows_per_block, ["k"], mine.count())
    n = digits + 1
    differ = " | ".join(f"(l_bits[w * {n} + {p}] ^ r_bits[w * {n} + {p}])" for p in range(1, n))
    together = F.expr(f"aggregate(sequence(0, {width - 1}), 0L, (s, w) -> s + bit_count(l_bits[w * {n}] & r_bits[w * {n}] & ~({differ})))")
    both = F.expr("aggregate(zip_with(l_held, r_held, (a, b) -> bit_count(a & b)), 0L, (s, x) -> s + x)")
    if width * n <= 64:  # few words are written out, which compiles
        apart = lambda w: " | ".join(f"(l_bits[{w * n + p}] ^ r_bits[{w * n + p}])" for p in range(1, n))
        together = F.expr(" + ".join(f"CAST(bit_count(l_bits[{w * n}] & r_bits[{w * n}] & ~({apart(w)})) AS BIGINT)" for w in range(width)))
        both = F.expr(" + ".join(f"CAST(bit_count(l_held[{w}] & r_held[{w}]) AS BIGINT)" for w in range(width)))
    return met.select("k", "i", "j", together.alias("_t"), both.alias("_b")).select("k", "i", "j", F.when(F.col("_b") > 0, F.col("_t") / F.col("_b")).alias("consensus"))


# -------------------------------------------------------- #136-#139, #94


def pac(c: DataFrame, lo: float = PAC_LOW, hi: float = PAC_HIGH, group: str = "k", v: str = "consensus") -> DataFrame:
    """PAC = F(first value >= hi) - F(last value <= lo) on the ECDF per group (#136).

    No value >= hi: the last CDF value (1); no value <= lo: 0.
    """
    from citegraph.operators.windows import ecdf

    e = ecdf(c.filter(F.col(v).isNotNull()), group, v)
    return e.groupBy(group).agg(
        (
            F.coalesce(F.min_by(F.when(F.col(v) >= hi, F.col("F")), F.when(F.col(v) >= hi, F.col(v))), F.lit(1.0))
            - F.coalesce(F.max_by(F.when(F.col(v) <= lo, F.col("F")), F.when(F.col(v) <= lo, F.col(v))), F.lit(0.0))
        ).alias("pac")
    )


def cdf_area_delta(c: DataFrame, group: str = "k", v: str = "consensus") -> DataFrame:
    """Area under the ECDF by the Monti (2003) sum Σ (v_i - v_{i-1})·F(v_i) over distinct values,
    and its relative change to the previous k (the first k keeps its area) (#137)."""
    from citegraph.operators.windows import ecdf

    e = ecdf(c.filter(F.col(v).isNotNull()), group, v)
    # previous distinct value of the same group: number the distinct values
    # globally and join each to its predecessor (an equi-join, no group window)
    from citegraph.operators.windows import row_number_global

    idx = row_number_global(e, [group, v], "_ix")
    prev = idx.select(group, (F.col("_ix") + 1).alias("_ix"), F.col(v).alias("_pv"))
    steps = idx.join(prev, [group, "_ix"], "left").withColumn("_step", (F.col(v) - F.col("_pv")) * F.col("F"))
    area = steps.groupBy(group).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("area"))
    # one row per k: a single ordered window over the k values is tiny
    wk = W.orderBy(group)
    prevk = F.lag("area").over(wk)
    return area.withColumn("delta", F.when(prevk.isNull(), F.col("area")).otherwise((F.col("area") - prevk) / prevk))


def consensus_histogram(c: DataFrame, bins: int = 100, group: str = "k", v: str = "consensus") -> DataFrame:
    """Share of values per bin of [0, 1] (#138); value 1 falls in the last bin."""
    b = F.least(F.floor(F.col(v) * bins).cast("int"), F.lit(bins - 1))
    h = c.filter(F.col(v).isNotNull()).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    t = h.groupBy(group).agg(F.sum("_n").alias("_t"))
    return h.join(t, group).select(group, "bin", (F.col("_n") / F.col("_t")).alias("density"))


def bimodality_coefficient(df: DataFrame, group: str, v: str) -> DataFrame:
    """BC = (G1² + 1) / (K · (n-1)² / ((n-2)(n-3))) with bias-corrected skewness G1 and kurtosis K (#139).

    From population moments: G1 = g1·√(n(n-1))/(n-2); K = 3 + (n-1)/((n-2)(n-3))·((n+1)k - 3(n-1)),
    k = population (non-excess) kurtosis.
    """
    a = df.filter(F.col(v).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.skewness(v).alias("_g1"), (F.kurtosis(v) + 3).alias("_kp")
    )
    n = F.col("_n")
    G1 = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    K = F.lit(3.0) + (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_kp") - 3 * (n - 1))
    d1 = (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return a.select(group, ((G1 * G1 + 1) / (K * d1)).alias("bc"))


# ----------------------------------------------------------- #114, #99


#: rows of a block of ``block_pairs``, at most
BLOCK_ROWS = 6000


def _rows_per_block(n: int, cores: int) -> int:
    """Blocks whose pairs are a few times as many as the cores, of at most ``BLOCK_ROWS`` rows: a row is copied once a block."""
    return max(16, min(BLOCK_ROWS, -(-n // math.ceil(math.sqrt(8 * cores)))))


def block_pairs(df: DataFrame, id_col: str, rows_per_block: int | None = None, by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Every pair i < j of the rows of ``df`` (of one ``by`` group) once: (by, i, j, l_..., r_...).

    Rows are dealt by hash into blocks of about ``rows_per_block`` (see
    ``_rows_per_block``); each pair of blocks is a key, under which the left
    rows come from one block and the right ones from the other. A row is copied
    once for each block, and a task compares two blocks, whatever the table's size.
    """
    by = by or []
    n = df.count() if n is None else n
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // (rows_per_block or _rows_per_block(n, cores))))
    rest = [c for c in df.columns if c not in (id_col, *by)]
    dealt = df.withColumn("_x", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = dealt.filter("_x <= _y").select(*by, "_x", "_y", F.col(id_col).alias("_i"), *[F.col(c).alias(f"l_{c}") for c in rest])
    right = dealt.filter("_y <= _x").select(*by, F.col("_y").alias("_x"), F.col("_x").alias("_y"), F.col(id_col).alias("_j"), *[F.col(c).alias(f"r_{c}") for c in rest])
    # both sides are copied once a block: their files' size, by which they would be broadcast or their tasks merged, says nothing
    tasks = max(min(2000, -(-n ** 2 // 10_000_000)), min(4 * cores, blocks * (blocks + 1) // 2))
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) or blocks > 1:
        left, right = (side.repartition(tasks, *by, "_x", "_y") for side in (left, right))
    met = left.join(right.hint("merge"), [*by, "_x", "_y"]).filter((F.col("_x") < F.col("_y")) | (F.col("_i") < F.col("_j")))
    swap = F.col("_i") > F.col("_j")
    sides = [F.when(swap, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for c in rest for a, b in (("l", "r"), ("r", "l"))]
    return met.select(*by, F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), *sides)


def _own_parts(x: DataFrame, metrics: list[str]) -> DataFrame:
    """``x`` with what ``distance`` works out of one vector alone: norms, deviations from the mean and their sums of squares."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    square = lambda v: total(F.transform(v, lambda p: p * p))
    if "cosine" in metrics:
        x = x.withColumn("norm", F.sqrt(square(F.col("vec"))))
    if "correlation" in metrics:
        x = x.withColumn("dev", F.transform("vec", lambda p: p - total(F.col("vec")) / F.size("vec").cast("double")))
        x = x.withColumn("dev2", square(F.col("dev")))
    return x


def _paired(metric: str) -> Column:
    """``distance`` of the pairs of ``_own_parts``: the same sums, one product a pair."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    if metric == "cosine":
        norm = F.col("l_norm") * F.col("r_norm")
        return F.when(norm > 0, 1 - dot("l_vec", "r_vec") / norm).otherwise(F.lit(1.0))
    if metric == "correlation":
        norm = F.sqrt(F.col("l_dev2") * F.col("r_dev2"))
        return F.when(norm > 0, 1 - F.greatest(dot("l_dev", "r_dev") / norm, F.lit(0.0))).otherwise(F.lit(1.0))
    return distance("l_vec", "r_vec", metric)


def pair_distance(v: DataFrame, metric: str | list[str] = "cosine", id_col: str = "id", vec: str = "vec", rows_per_block: int | None = None) -> DataFrame:
    """Pairwise distances (i < j, dist) of a vector table (#114); a list of metrics gives a column of each name."""
    metrics = [metric] if isinstance(metric, str) else metric
    x = v.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    met = block_pairs(_own_parts(x, metrics), "id", rows_per_block)
    return met.select("i", "j", *[_paired(m).alias("dist" if isinstance(metric, str) else m) for m in metrics])


def pairwise_k_extreme(d: DataFrame, k: int, largest: bool = False) -> DataFrame:
    """k smallest (largest) distances per item over both pair directions (#99)."""
    from citegraph.operators.windows import topk_per_group

    both = d.select("i", "j", "dist").unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    if largest:
        return topk_per_group(both, "j", "dist", "i", k)
    neg = both.withColumn("_neg", -F.col("dist"))
    return topk_per_group(neg, "j", "_neg", "i", k).drop("_neg")


# ------------------------------------------------------------ #143, #144


def stratified_fold(df: DataFrame, stratum: str, id_col: str, n: int = 10, seed: int = 42) -> DataFrame:
    """Fold 0..n-1 dealt round-robin within each stratum in hash order (#143).

    Positions inside a stratum come from the distributed global numbering
    over (stratum, hash) minus the stratum's first position, so a stratum
    holding most rows is still spread over many tasks.
    """
    from citegraph.functions.columns import stable_hash
    from citegraph.operators.windows import row_number_global

    x = df.withColumn("_h", stable_hash(id_col, seed))
    rn = row_number_global(x, [stratum, "_h", id_col], "_rn")
    base = rn.groupBy(stratum).agg(F.min("_rn").alias("_base"))
    return rn.join(base, stratum).withColumn("fold", ((F.col("_rn") - F.col("_base")) % n).cast("int")).drop("_h", "_rn", "_base")


def pca_project(v: DataFrame, k: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """First ``k`` principal components of mean-centred vectors (#144), Spark ML PCA."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = v.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("f"))
    sc = StandardScaler(withMean=True, withStd=False, inputCol="f", outputCol="c").fit(x)
    xc = sc.transform(x)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(xc)
    return model.transform(xc).select(id_col, vector_to_array("p").alias("score"))
