"""Benchmark decontamination with a broadcast hash set (DataFrame functions only).

Words are runs of ASCII letters and digits (A-Z folded) and of non-ASCII
characters. An item's windows are its runs of 13 consecutive words; an item
of fewer words, but not none, is one window.

Scan: each window of L words that occurs in a document holds one of the
document's grams of g = (L + 1) // 2 words that start at a multiple of g, so
only every g-th gram is hashed and looked up in the set of all hashed grams
of the test windows. The set goes to the tasks while it has at most
``max_set`` values; a larger one is joined by its hash instead. Documents
with a hit are then verified: their windows meet the test windows word by
word in an equi-join.

Edge cases: null and empty texts have no words and no windows; rows that
repeat a doc_id are judged each by its own text; null item_ids count as
windows, but not as items; other columns are passed through by
``remove_documents`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citegraph.llm.store import ascii_lower, packed, text_key, unpacked, write_once

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: largest set of gram hashes that is sent to the tasks (8 bytes each)
MAX_SET = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), 0), F.array().cast("array<string>"))


def _starts(n: Column, length: int, step: int = 1) -> Column:
    """0-based starts of the grams of ``length`` words, every ``step``-th; empty if there are none."""
    last = F.floor((n - length) / step)
    return F.when(n >= length, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))


def _grams(ws: Column, length: int, step: int) -> Column:
    """(start, words) of the grams of ``length`` words that start at a multiple of ``step``."""
    gram = lambda i: F.slice(ws, (i * step + 1).cast("int"), F.lit(length))
    return F.transform(_starts(F.size(ws), length, step), lambda i: F.struct((i * step).alias("start"), gram(i).alias("words")))


def test_windows(benchmark: DataFrame) -> DataFrame:
    """(len, key, items): distinct windows with the ids of their items."""
    w = F.col("_w")
    size = F.least(F.size(w), F.lit(WINDOW))
    wins = (
        benchmark.select("item_id", words(F.col("text")).alias("_w"))
        .filter(F.size(w) > 0)
        .select("item_id", size.alias("len"), "_w", F.explode(F.sequence(F.lit(1), F.size(w) - size + 1)).alias("_s"))
        .select("item_id", "len", F.array_join(F.slice(w, F.col("_s"), F.col("len")), " ").alias("key"))
    )
    return wins.groupBy("len", "key").agg(F.collect_set("item_id").alias("items"))


def _seeds(wins: DataFrame, length: int) -> DataFrame:
    """Hashes of all grams of (length + 1) // 2 words inside the test windows of ``length``."""
    g = (length + 1) // 2
    ws = F.split("key", " ")
    grams = F.transform(F.sequence(F.lit(1), F.lit(length - g + 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(g))))
    return wins.filter(F.col("len") == length).select(F.explode(grams).alias("seed")).distinct()


def _candidates(docs: DataFrame, wins: DataFrame, lengths: list[int], max_set: int) -> DataFrame:
    """Rows of ``docs`` (with ``_w``) that hold a seed gram of some window length."""
    hit = F.lit(False)
    for length in lengths:
        g = (length + 1) // 2
        seeds = _seeds(wins, length)
        grams = F.transform(_grams(F.col("_w"), g, g), lambda x: F.xxhash64(x["words"]))
        few = [r[0] for r in seeds.limit(max_set + 1).collect()]
        if not few:
            continue
        if len(few) <= max_set:
            docs = docs.select("*", F.explode(F.array(grams)).alias(f"_g{length}"))
            hit = hit | F.expr(f"exists(_g{length}, h -> h IN ({','.join(f'{x}L' for x in few)}))")
        else:
            found = docs.select("doc_id", "_t", F.explode(grams).alias("seed")).join(seeds, "seed", "left_semi").select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).distinct().withColumn(f"_f{length}", F.lit(True))
            docs = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left").drop("_d", "_u")
            hit = hit | F.coalesce(F.col(f"_f{length}"), F.lit(False))
    return docs.filter(hit)


def occurrences(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """(doc_id, _t, start, len, items): every test window inside a document, verified word by word."""
    wins = write_once(test_windows(benchmark), "test-windows")
    lengths = sorted(r[0] for r in wins.select("len").distinct().collect())  # at most WINDOW values
    # the generator keeps the words of a row from being computed again in every expression on them
    docs = docs.select("doc_id", text_key(F.col("text")).alias("_t"), F.explode(F.array(words(F.col("text")))).alias("_w"))
    cand = _candidates(docs, wins, lengths, max_set)
    small = wins.count() <= max_set
    out = None
    for length in lengths:
        own = wins.filter(F.col("len") == length).select("key", "items")
        rows = cand.select("doc_id", "_t", F.explode(_grams(F.col("_w"), length, 1)).alias("x"))
        rows = rows.select("doc_id", "_t", "x.start", F.array_join("x.words", " ").alias("key"))
        got = rows.join(F.broadcast(own) if small else own, "key").select("doc_id", "_t", "start", F.lit(length).alias("len"), "items")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id bigint, _t bigint, start bigint, len int, items array<bigint>")
    return out.distinct()


def report(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """Per distinct (doc_id, text) with a hit: word count inside windows, items found."""
    occ = occurrences(docs, benchmark, max_set)
    before = W.partitionBy("doc_id", "_t").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = occ.select("doc_id", "_t", "start", (F.col("start") + F.col("len")).alias("end"), "items")
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    return (
        spans.withColumn("_new", new)
        .groupBy("doc_id", "_t")
        .agg(F.sum("_new").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )


def judged(docs: DataFrame, benchmark: DataFrame, carry: bool = False, max_set: int = MAX_SET) -> DataFrame:
    """Every row's _id, _n words, _hit words inside windows, _items, and _bad (_hit > 0 and 5 % of
    the words or more); with ``carry`` the whole row too, packed as ``_row``."""
    hits = report(docs, benchmark, max_set).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), F.col("n_hit").alias("_hit"), F.col("items").alias("_items"))
    # WORDS without the folding: A-Z are word characters too
    n_words = F.coalesce(F.regexp_count(F.col("_row.text"), F.lit(WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))), F.lit(0)).cast("long")
    rows = packed(docs).select(F.col("_row.doc_id").alias("_id"), text_key(F.col("_row.text")).alias("_t"), n_words.alias("_n"), *(["_row"] if carry else []))
    out = rows.join(hits, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left")
    out = out.withColumn("_hit", F.coalesce("_hit", F.lit(0)).cast("long"))
    return out.withColumn("_bad", (F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_n")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the same columns."""
    return unpacked(judged(docs, benchmark, True, max_set).filter(~F.col("_bad")))


def hit_spans(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """(doc_id, start, end, items): word spans of all test windows found, for span removal."""
    return occurrences(docs, benchmark, max_set).select("doc_id", "start", (F.col("start") + F.col("len")).alias("end"), "items")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform(F.coalesce("_items", F.array().cast("array<string>")), lambda i: i.cast("string")))
    return judged(docs, benchmark).select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("_bad").alias("contaminated"),
    )
