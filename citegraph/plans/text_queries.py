"""Catalog: text statistics per theme (documents.source plays the theme)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.functions.stopwords import ENGLISH, FUNCTION_WORDS
from citegraph.operators import text as X
from citegraph.plans import standins as S
from citegraph.plans.common import rounded
from citegraph.plans.registry import register
from citegraph.plans.sqlparts import with_


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = _sql_list(ENGLISH)
WORD_RE = r"'[\p{L}\p{N}_]+'"


def _tok(min_len: int = 1, stop: bool = True) -> str:
    cond = [] if not stop else [f"NOT list_contains({STOP}, word)"]
    if min_len > 1:
        cond.append(f"length(word) >= {min_len}")
    where = (" WHERE " + " AND ".join(cond)) if cond else ""
    return (
        "SELECT doc_id, cluster, word FROM (SELECT doc_id, source AS cluster, "
        f"unnest(regexp_extract_all(lower(text), {WORD_RE})) AS word FROM documents) x{where}"
    )


T = f"t AS ({_tok()})"
T2 = f"t2 AS ({_tok(2)})"
DOCS = "docs AS (SELECT doc_id, source AS cluster FROM documents)"


def _docs(spark, d):
    return S.theme_documents(spark, d)


def _t(spark, d, min_len=1):
    return X.token_table(_docs(spark, d), "doc_id", "cluster", "text", min_len=min_len)


@register(
    "tokenise",
    f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, tk[1] AS first_token, tk[len(tk)] AS last_token FROM "
    f"(SELECT doc_id, regexp_extract_all(lower(text), {WORD_RE}) AS tk FROM documents)",
)
def tokenise(spark, d):
    x = X.tokenise(S.table(spark, d, "documents").select("doc_id", "text"), "text")
    return x.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.get("tokens", 0).alias("first_token"),
        F.element_at("tokens", -1).alias("last_token"),
    )


@register(
    "remove_stopwords",
    f"SELECT doc_id, CAST(len(list_filter(tk, lambda w: NOT list_contains({STOP}, w))) AS BIGINT) AS n_kept FROM "
    f"(SELECT doc_id, regexp_extract_all(lower(text), {WORD_RE}) AS tk FROM documents)",
)
def remove_stopwords(spark, d):
    x = X.remove_stopwords(X.tokenise(S.table(spark, d, "documents").select("doc_id", "text"), "text"))
    return x.select("doc_id", F.size("tokens").cast("bigint").alias("n_kept"))


def _lang_sql() -> str:
    langs = list(FUNCTION_WORDS)
    cols = ", ".join(
        f"len(list_filter(tk, lambda w: list_contains({_sql_list(FUNCTION_WORDS[l])}, w))) AS s_{l}" for l in langs
    )
    g = "GREATEST(" + ", ".join(f"s_{l}" for l in langs) + ")"
    whens = " ".join(f"WHEN s_{l} = {g} THEN '{l}'" for l in langs)
    return f"""SELECT doc_id, CASE WHEN {g} = 0 THEN NULL {whens} END AS detected_lang FROM (
  SELECT doc_id, {cols} FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD_RE}) AS tk FROM documents))"""


@register("language_scores", _lang_sql())
def language_scores(spark, d):
    """Detected language of every document (function-word scores, argmax)."""
    return X.language_scores(S.table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "detected_lang")


@register("language_filter", f"SELECT l.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars FROM ({_lang_sql()}) l JOIN documents d USING (doc_id) WHERE detected_lang = 'en'")
def language_filter(spark, d):
    """Documents detected as English, whole texts kept."""
    kept, _ = X.language_filter(S.table(spark, d, "documents").select("doc_id", "text"), "text")
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars"))


@register("word_count_by_cluster", with_(T) + "SELECT c.cluster, c.word, c.n, g.n_global FROM (SELECT cluster, word, COUNT(*) AS n FROM t GROUP BY 1, 2) c "
          "JOIN (SELECT word, COUNT(*) AS n_global FROM t GROUP BY 1) g USING (word)")
def word_count_by_cluster(spark, d):
    return X.word_count_by_cluster(_t(spark, d))


@register(
    "distinctiveness",
    with_(T)
    + """, c AS (SELECT cluster, word, COUNT(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT word, COUNT(*) AS n_global FROM t GROUP BY 1)
SELECT * FROM (SELECT c.cluster, c.word, c.n, g.n_global, ROUND(CAST(c.n AS DOUBLE) / g.n_global, 6) AS score,
  ROW_NUMBER() OVER (PARTITION BY c.cluster ORDER BY CAST(c.n AS DOUBLE) / g.n_global DESC, c.word) AS rank
  FROM c JOIN g USING (word)) WHERE rank <= 50""",
)
def distinctiveness(spark, d):
    return rounded(X.distinctiveness(_t(spark, d), 50))


CLASS_TF = """c AS (SELECT cluster, word, COUNT(*) AS n FROM t GROUP BY 1, 2),
tf AS (SELECT c.cluster, c.word, c.n, CAST(c.n AS DOUBLE) / s.tot AS tf FROM c JOIN (SELECT cluster, SUM(n) AS tot FROM c GROUP BY 1) s USING (cluster))"""


@register("class_tf", with_(T, CLASS_TF) + "SELECT cluster, word, n, ROUND(tf, 6) AS tf FROM tf")
def class_tf(spark, d):
    return rounded(X.class_tf(_t(spark, d)))


@register(
    "class_tfidf",
    with_(T, CLASS_TF)
    + "SELECT tf.cluster, tf.word, tf.n, ROUND(tf.tf, 6) AS tf, ROUND(tf.tf * ln((SELECT COUNT(DISTINCT cluster) FROM t) / CAST(w.df AS DOUBLE)), 6) AS tfidf "
    "FROM tf JOIN (SELECT word, COUNT(*) AS df FROM tf GROUP BY 1) w USING (word)",
)
def class_tfidf(spark, d):
    return rounded(X.class_tfidf(_t(spark, d)))


DOC_TFIDF = """c2 AS (SELECT cluster, doc_id, word, COUNT(*) AS n FROM t2 GROUP BY ALL),
nd AS (SELECT cluster, COUNT(DISTINCT doc_id) AS nn FROM docs GROUP BY cluster),
dfw AS (SELECT cluster, word, COUNT(*) AS df FROM c2 GROUP BY cluster, word),
v AS (SELECT c2.cluster, c2.doc_id, c2.word, c2.n * (ln((1 + nd.nn) / (1 + dfw.df)) + 1) AS v
      FROM c2 JOIN nd USING (cluster) JOIN dfw USING (cluster, word)),
nrm AS (SELECT cluster, doc_id, sqrt(SUM(v * v)) AS norm FROM v GROUP BY ALL)"""

CL_TFIDF = """c3 AS (SELECT cluster, word, COUNT(*) AS n FROM t2 GROUP BY ALL),
ncl AS (SELECT COUNT(DISTINCT cluster) AS nn FROM docs),
dfc AS (SELECT word, COUNT(*) AS df FROM c3 GROUP BY word),
v3 AS (SELECT c3.cluster, c3.word, c3.n * (ln((1 + ncl.nn) / (1 + dfc.df)) + 1) AS v FROM c3 JOIN dfc USING (word) CROSS JOIN ncl),
cs AS (SELECT v3.cluster, v3.word, v3.v / n.norm AS score FROM v3 JOIN (SELECT cluster, sqrt(SUM(v * v)) AS norm FROM v3 GROUP BY cluster) n USING (cluster))"""

CENTRED = """cen AS (SELECT cl.cluster, m.word, COALESCE(cs.score, 0.0) - m.mean AS score
  FROM (SELECT word, SUM(score) / (SELECT nn FROM ncl) AS mean FROM cs GROUP BY word) m
  CROSS JOIN (SELECT DISTINCT cluster FROM docs) cl LEFT JOIN cs ON cs.word = m.word AND cs.cluster = cl.cluster)"""


def _t2_docs(spark, d):
    docs = _docs(spark, d)
    return X.token_table(docs, "doc_id", "cluster", "text", min_len=2), docs.select("doc_id", "cluster")


@register(
    "doc_tfidf_sum",
    with_(T2, DOCS, DOC_TFIDF) + "SELECT v.cluster, v.word, ROUND(SUM(v.v / nrm.norm), 6) AS score FROM v JOIN nrm USING (cluster, doc_id) GROUP BY 1, 2",
)
def doc_tfidf_sum(spark, d):
    t2, docs = _t2_docs(spark, d)
    return rounded(X.doc_tfidf_sum(t2, docs))


@register("cluster_tfidf", with_(T2, DOCS, CL_TFIDF) + "SELECT cluster, word, ROUND(score, 6) AS score FROM cs")
def cluster_tfidf(spark, d):
    t2, docs = _t2_docs(spark, d)
    return rounded(X.cluster_tfidf(t2, docs))


@register("centred_cluster_tfidf", with_(T2, DOCS, CL_TFIDF, CENTRED) + "SELECT cluster, word, ROUND(score, 6) AS score FROM cen")
def centred_cluster_tfidf(spark, d):
    t2, docs = _t2_docs(spark, d)
    return rounded(X.centred_cluster_tfidf(t2, docs))


@register(
    "top_words_matrix",
    # the centred table is read twice: its parts are computed once
    with_(T2, DOCS, CL_TFIDF, CENTRED).replace(" AS (", " AS MATERIALIZED (")
    + """SELECT cluster, word, ROUND(score, 6) AS score FROM cen WHERE word IN (
  SELECT word FROM (SELECT word, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY score DESC, word) AS r FROM cen) WHERE r <= 500)""",
)
def top_words_matrix(spark, d):
    t2, docs = _t2_docs(spark, d)
    return rounded(X.top_words_matrix(X.centred_cluster_tfidf(t2, docs), 500))


@register(
    "chunk_tokens",
    f"""SELECT doc_id, CAST(c - 1 AS INTEGER) AS chunk, CAST(len(ch) AS BIGINT) AS n_tokens, ch[1] AS first_token, ch[len(ch)] AS last_token FROM (
  SELECT doc_id, tk[(c - 1) * 512 + 1 : c * 512] AS ch, c FROM (
    SELECT doc_id, tk, unnest(range(1, CAST(ceil(len(tk) / 512.0) AS BIGINT) + 1)) AS c FROM
      (SELECT doc_id, regexp_extract_all(lower(text), {WORD_RE}) AS tk FROM documents) WHERE len(tk) > 0))""",
)
def chunk_tokens(spark, d):
    x = X.tokenise(S.table(spark, d, "documents").select("doc_id", "text"), "text")
    ch = X.chunk_tokens(x, "doc_id", "tokens", 512)
    return ch.select(
        "doc_id",
        "chunk",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.get("tokens", 0).alias("first_token"),
        F.element_at("tokens", -1).alias("last_token"),
    )


_CHUNKS = f"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD_RE}) AS tk FROM documents),
tok AS (SELECT doc_id, t.w AS w, (t.i - 1) // 512 AS chunk FROM (SELECT doc_id, unnest(list_transform(tk, lambda w, i: {{'w': w, 'i': i}})) AS t FROM tk))"""


def _vector_digest(df):
    """(doc_id, dims, squared length, weighted sum) of embeddings."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    places = F.sequence(F.lit(1), F.size("embedding"))
    weighted = F.zip_with("embedding", places, lambda x, i: x * i)
    return rounded(df.select("doc_id", F.size("embedding").cast("long").alias("dims"), total(F.transform("embedding", lambda x: x * x)).alias("squares"), total(weighted).alias("checksum")))


@register(
    "embed_texts",
    with_(_CHUNKS)
    + """, h AS (SELECT doc_id, chunk, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS b, CASE WHEN CAST(('0x' || substr(md5(w), 9, 8)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM tok),
v AS (SELECT doc_id, chunk, b, CAST(SUM(s) AS DOUBLE) AS x FROM h GROUP BY ALL),
u AS (SELECT doc_id, b, x / NULLIF(sqrt(SUM(x * x) OVER (PARTITION BY doc_id, chunk)), 0) AS x FROM v),
c AS (SELECT doc_id, COUNT(DISTINCT chunk) AS n FROM tok GROUP BY 1),
e AS (SELECT doc_id, b, SUM(coalesce(x, 0)) / MIN(n) AS x FROM u JOIN c USING (doc_id) GROUP BY 1, 2)
SELECT tk.doc_id, CAST(64 AS BIGINT) AS dims, ROUND(coalesce(SUM(x * x), 0), 6) AS squares, ROUND(coalesce(SUM(x * (b + 1)), 0), 6) AS checksum
FROM tk LEFT JOIN e USING (doc_id) GROUP BY 1""",
)
def embed_texts(spark, d):
    """Chunked texts, signed feature hashing (md5), mean-pooled per document; every document has a vector."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return _vector_digest(X.embed_texts(docs, "doc_id", "text", dim=64, chunk=512, hasher="md5"))


def _word_lengths():
    """A small model: number of tokens, of characters and of long tokens of each chunk."""
    import numpy as np

    def predict(texts):
        words = [str(t).split(" ") for t in texts]
        return np.array([[len(w), sum(map(len, w)), sum(len(x) > 6 for x in w)] for w in words], float)

    return predict


@register(
    "embed_texts_model",
    with_(_CHUNKS)
    + """, v AS (SELECT doc_id, chunk, COUNT(*) AS a, SUM(length(w)) AS b, COUNT(*) FILTER (WHERE length(w) > 6) AS c FROM tok GROUP BY 1, 2),
e AS (SELECT doc_id, AVG(a) AS a, AVG(b) AS b, AVG(c) AS c FROM v GROUP BY 1)
SELECT tk.doc_id, CAST(3 AS BIGINT) AS dims, ROUND(coalesce(a * a + b * b + c * c, 0), 6) AS squares, ROUND(coalesce(a + 2 * b + 3 * c, 0), 6) AS checksum FROM tk LEFT JOIN e USING (doc_id)""",
)
def embed_texts_model(spark, d):
    """The same chunks through a plugged-in batch model."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return _vector_digest(X.embed_texts(docs, "doc_id", "text", dim=3, chunk=512, encoder=_word_lengths))


@register("group_concat_text", with_(T2) + "SELECT cluster, word, COUNT(*) AS n FROM t2 GROUP BY 1, 2")
def group_concat_text(spark, d):
    """A cluster's titles as one document, in bag-of-words form: term counts per cluster.

    The reference joins every title of a cluster into one string; the term
    frequencies of that string are exactly these counts, and no cluster-sized
    value is ever built in one row.
    """
    from citegraph.operators.text import group_concat_terms

    t2, _ = _t2_docs(spark, d)
    return group_concat_terms(t2)
