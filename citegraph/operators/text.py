"""Text statistics per theme (#115-#126), as relational Spark jobs.

A token table ``T(doc_id, cluster, word)`` is the common currency: texts are
tokenised with JVM regex functions and exploded, and every statistic is a
grouped count joined with per-cluster / per-word aggregates. Documents are
never concatenated into one string per cluster (the reference's
``' '.join`` of a cluster's titles): term counts per cluster give the same
term frequencies without building a cluster-sized value in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions.columns import col, tokens
from citegraph.functions.stopwords import ENGLISH, FUNCTION_WORDS
from citegraph.session import cut_lineage

# ---------------------------------------------------------------- tokens


def tokenise(df: DataFrame, text: str, out: str = "tokens", min_len: int = 1) -> DataFrame:
    """Lower-case Unicode word tokens of the whole text (#115)."""
    return df.withColumn(out, tokens(text, min_len))


def remove_stopwords(df: DataFrame, tokens_col: str = "tokens", stop: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Drop stop words from a token array (#116)."""
    words = list(stop or ENGLISH)  # a hash lookup in the plan
    return df.withColumn(out or tokens_col, F.filter(col(tokens_col), lambda t: ~t.isin(words)))


def stopword_table(spark, stop: list[str] | None = None) -> DataFrame:
    """The stop-word list as a one-column table (179 rows for English)."""
    return spark.createDataFrame([(w,) for w in (stop or ENGLISH)], "word STRING")


def token_table(df: DataFrame, id_col: str, cluster: str, text: str, stop: bool = True, min_len: int = 1) -> DataFrame:
    """T(doc_id, cluster, word): one row per token occurrence of the whole text.

    Stop words are removed with a broadcast anti-join against the fixed
    stop-word table (a hash lookup per token).
    """
    x = df.select(F.col(id_col).alias("doc_id"), F.col(cluster).alias("cluster"), F.explode(tokens(text, min_len)).alias("word"))
    if stop:
        x = x.join(F.broadcast(stopword_table(df.sparkSession)), "word", "left_anti")
    return x.select("doc_id", "cluster", "word")


def language_scores(df: DataFrame, text: str, out: str = "detected_lang") -> DataFrame:
    """Language of each text by function-word hits, argmax; no hit -> NULL (#117).

    Scores are computed on the row's token array (no shuffle).
    """
    df = df.withColumn("_tokens", tokens(text))  # cut once for all languages
    hits = lambda words: F.size(F.filter("_tokens", lambda t: t.isin(*words)))
    scores = [(lang, hits(words)) for lang, words in FUNCTION_WORDS.items()]
    # argmax with ties resolved by dict order: build a struct (score, -rank, lang) and take the max
    structs = [F.struct(s.alias("s"), F.lit(-i).alias("r"), F.lit(lang).alias("lang")) for i, (lang, s) in enumerate(scores)]
    best = F.greatest(*structs)
    return df.withColumn(out, F.when(best["s"] > 0, best["lang"])).drop("_tokens")


def language_filter(df: DataFrame, text: str, keep: str = "en", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows detected as ``keep`` and a keyed table (id, is_english) of every row (#117)."""
    scored = language_scores(df, text)
    mask = scored.select(id_col, F.coalesce(F.col("detected_lang") == keep, F.lit(False)).alias("is_english"))
    return scored.filter(F.col("detected_lang") == keep).drop("detected_lang"), mask


# ------------------------------------------------------------- statistics


def word_count_by_cluster(t: DataFrame) -> DataFrame:
    """(cluster, word, n, n_global) (#68)."""
    n = t.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    g = t.groupBy("word").agg(F.count(F.lit(1)).alias("n_global"))
    return n.join(g, "word")


def group_concat_terms(t: DataFrame) -> DataFrame:
    """Concatenated cluster document as term counts (cluster, word, n) (#69)."""
    return t.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))


def distinctiveness(t: DataFrame, k: int = 50) -> DataFrame:
    """count in cluster / global count, top k per cluster (ties by word) (#118)."""
    from citegraph.operators.windows import topk_per_group

    c = word_count_by_cluster(t).withColumn("score", F.col("n") / F.col("n_global"))
    return topk_per_group(c, "cluster", "score", "word", k)


def class_tf(t: DataFrame) -> DataFrame:
    """count / cluster total (#119); the cluster total is an aggregate joined back.

    The (cluster, word) count table is written once: it is read for the
    totals, the TF and the document frequencies, and the token table behind
    it is the expensive part (tokenising whole texts).
    """
    n = cut_lineage(t.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n")))
    tot = n.groupBy("cluster").agg(F.sum("n").alias("_tot"))
    return n.join(tot, "cluster").withColumn("tf", F.col("n") / F.col("_tot")).drop("_tot")


def class_tfidf(t: DataFrame) -> DataFrame:
    """tf · ln(#clusters / #clusters containing the word), no smoothing (#120)."""
    tf = class_tf(t)
    n_clusters = tf.select("cluster").distinct().count()
    df_w = tf.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    return tf.join(df_w, "word").withColumn("tfidf", F.col("tf") * F.log(F.lit(float(n_clusters)) / F.col("_df"))).drop("_df")


def _smoothed_l2(counts: DataFrame, doc_key: list[str], scope: list[str], docs: DataFrame | None = None) -> DataFrame:
    """Smoothed TF-IDF, L2-normalised per document.

    counts: (scope..., doc_key..., word, n). N = documents within ``scope``
    (from ``docs`` when given, so documents without tokens count too);
    idf = ln((1+N)/(1+df)) + 1; each document's vector is divided by its L2 norm.
    """
    src = docs if docs is not None else counts
    ndocs = src.select(*scope, *doc_key).distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("_N"))
    dfw = counts.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("_df"))
    x = counts.join(dfw, [*scope, "word"])
    x = x.join(ndocs, scope) if scope else x.withColumn("_N", ndocs.select("_N").scalar())
    x = x.withColumn("_v", F.col("n") * (F.log((1 + F.col("_N")) / (1 + F.col("_df"))) + 1))
    norm = x.groupBy(*scope, *doc_key).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    return x.join(norm, [*scope, *doc_key]).withColumn("tfidf", F.col("_v") / F.col("_norm")).drop("_v", "_norm", "_N", "_df")


def doc_tfidf_sum(t2: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Per cluster: smoothed L2 TF-IDF over its documents, summed per word (#121).

    ``t2`` must hold 2+ character tokens (the vectoriser's token rule);
    ``docs`` = (doc_id, cluster) of every document.
    """
    counts = cut_lineage(t2.groupBy("cluster", "doc_id", "word").agg(F.count(F.lit(1)).alias("n")))
    v = _smoothed_l2(counts, ["doc_id"], ["cluster"], docs)
    return v.groupBy("cluster", "word").agg(F.sum("tfidf").alias("score"))


def cluster_tfidf(t2: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Clusters as documents: smoothed L2 TF-IDF (#122)."""
    counts = cut_lineage(t2.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n")))
    return _smoothed_l2(counts, ["cluster"], [], docs).select("cluster", "word", F.col("tfidf").alias("score"))


def centred_cluster_tfidf(t2: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Cluster TF-IDF minus the word's mean over all clusters, zeros included (#123).

    The word x cluster grid is densified only for words present (a cluster
    without the word contributes 0 - mean).
    """
    s = cut_lineage(cluster_tfidf(t2, docs))
    clusters = (docs if docs is not None else s).select("cluster").distinct()
    n_clusters = clusters.count()
    mean = s.groupBy("word").agg((F.sum("score") / F.lit(float(n_clusters))).alias("_mean"))
    # the cluster list is one scalar array (length = number of clusters)
    grid = mean.withColumn("cluster", F.explode(clusters.agg(F.collect_list("cluster")).scalar()))
    return (
        grid.join(s, ["word", "cluster"], "left")
        .select("cluster", "word", (F.coalesce(F.col("score"), F.lit(0.0)) - F.col("_mean")).alias("score"))
    )


def top_words_matrix(centred: DataFrame, k: int = 500) -> DataFrame:
    """Rows of the centred matrix for the union of every cluster's top-k words (#124)."""
    from citegraph.operators.windows import topk_per_group

    top = topk_per_group(centred, "cluster", "score", "word", k).select("word").distinct()
    return centred.join(top, "word", "left_semi")


def chunk_tokens(df: DataFrame, id_col: str, tokens_col: str, n: int = 512) -> DataFrame:
    """Split token arrays into consecutive chunks of ``n`` (#125): (id, chunk, tokens)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(col(tokens_col)) - 1, F.lit(0)), F.lit(n))
    chunks = F.transform(starts, lambda s: F.slice(col(tokens_col), s + 1, n))
    return df.select(F.col(id_col), F.posexplode(chunks).alias("chunk", "tokens")).filter(F.size("tokens") > 0)


def _hashed(tok, dim: int, hasher: str):
    """(bucket, sign) of a token: 'xxhash64', or 'md5' (32-bit parts of it, which other engines have too)."""
    if hasher == "xxhash64":
        h = F.xxhash64(tok)
        return F.pmod(h, F.lit(dim)).cast("int"), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    if hasher == "md5":
        part = lambda at: F.conv(F.substring(F.md5(tok), at, 8), 16, 10).cast("bigint")
        return (part(1) % dim).cast("int"), F.when(part(9) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    raise ValueError(f"unknown hasher {hasher}")


def _pooled(x: DataFrame, id_col: str, dim: int, chunk: int) -> DataFrame:
    """(id, embedding) of rows (id, _codes): a code is twice a place of the vector, plus 1 for a negative sign."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            codes = batch.column("_codes")
            n = np.diff(codes.offsets.to_numpy())
            values = codes.flatten().to_numpy()
            chunks = -(-n // chunk)
            first = np.cumsum(chunks) - chunks
            at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            place = (np.repeat(first, n) + at // chunk) * dim + values // 2
            raw = np.bincount(place, 1.0 - 2 * (values % 2), minlength=int(chunks.sum()) * dim).reshape(-1, dim)
            norm = np.sqrt((raw * raw).sum(1, keepdims=True))
            unit = raw / np.where(norm > 0, norm, 1)
            out, has = np.zeros((len(n), dim)), np.flatnonzero(chunks)
            if len(has):
                out[has] = np.add.reduceat(unit, first[has], axis=0) / chunks[has][:, None]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(list(out), pa.list_(pa.float64()))], names=[id_col, "embedding"])

    return x.select(id_col, "_codes").mapInArrow(run, f"{id_col} {dict(x.dtypes)[id_col]}, embedding array<double>")


def embed_texts(df: DataFrame, id_col: str, text: str, dim: int = 64, chunk: int = 512, encoder=None, hasher: str = "xxhash64", batch_size: int = 64) -> DataFrame:
    """Chunk, encode, mean-pool per text (#126, #77): (id, embedding); a text without tokens gets zeros.

    The default encoder is signed feature hashing: a chunk's tokens add 1 or -1
    to one of ``dim`` places, and the chunk is scaled to unit length. Tokens are
    hashed by expressions, chunks pooled inside the row's own task: no shuffle. ``encoder`` plugs a model in: a
    function without arguments that a worker calls once, for a function from
    an array of chunk texts (tokens joined by spaces) to an array (chunks, dim);
    it runs in batches through ``predict_batch_udf``.
    """
    x = tokenise(df.select(id_col, text), text, "_tokens").drop(text).withColumn("_tokens", F.coalesce("_tokens", F.array().cast("array<string>")))
    if encoder is None:
        code = lambda t: (lambda b, sign: b * 2 + F.when(sign < 0, F.lit(1)).otherwise(F.lit(0)))(*_hashed(t, dim, hasher))
        return _pooled(x.withColumn("_codes", F.transform("_tokens", code)), id_col, dim, chunk)

    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    from citegraph.operators.aggregates import vector_mean

    predict = predict_batch_udf(encoder, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    x = cut_lineage(x)
    n = F.size("_tokens")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
    chunks = x.select(id_col, F.explode(F.transform(starts, lambda s: F.array_join(F.slice("_tokens", s, chunk), " "))).alias("_text"))
    pooled = vector_mean(chunks.select(id_col, predict("_text").alias("vec")), id_col, "vec", "_e")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return x.select(id_col).join(pooled, id_col, "left").select(id_col, F.coalesce("_e", zeros).alias("embedding"))
