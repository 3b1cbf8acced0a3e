"""Mixing sources to target weights with a low-discrepancy source schedule.

Targets: the sources, by code point and null last, weigh 5, 2, 1, repeating.
Together they get ``share`` times all words; no target passes ``most`` times
its source's words, the excess is reshared by weight (water-filling: the
level where sum(min(level * weight, most * size)) meets the total).

Stream of a source: its documents in the order of md5(doc_id), read again
from the start when it ends, cut into blocks of equal words. Running offsets
come from two prefix sums, over (source, md5 prefix) counts and inside one
prefix, so that a source with a third of all rows is spread over all tasks.

Schedule: slot i has the point frac(i * golden ratio) in 31-bit integers; the
source whose part of the cumulated weights holds the point owns the slot, and
its r-th slot plays its r-th block. What a source gives to the mix are the
blocks that win a slot, and nothing else. Slots go on until each source's
share of them covers its blocks and ``SPARE`` more, which is past what the
sequence's discrepancy can take from it; slots past a source's last block stay
unused. That block is cut at the target, so words meet targets to the word
(but for sources below about a millionth of the mix, see ``MOST_SLOTS``).

Edge cases: null texts and texts without words have size 0 and are not
played; a null source is a source; rows with equal doc_ids are ordered by
their text's hash, and exact repeats of a row are played one after the other, each
for itself; extra columns are ignored, or passed through by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.llm.store import WORD, packed, unpacked, write_once

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: slots of the schedule; a block has 1 / SLOTS of all words to play, and 64 words at least
SLOTS = 1 << 16
LEAST_BLOCK = 64
#: slots that a source's share of the schedule has beyond its blocks, and the bound of a schedule
SPARE = 16
MOST_SLOTS = 1 << 24
#: golden-ratio step and modulus of the schedule's points
GOLDEN, MODULUS = 1_327_217_885, 1 << 31
#: rows that one (source, md5 prefix) cell holds on average, at most
CELL = 20_000


def _hashable(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return not isinstance(kind, (T.MapType, T.VariantType)) and all(map(_hashable, inner))


def _name(docs: DataFrame, of: str = "") -> Column:
    """Hash of a row's columns; rows that share it are taken as equal (columns with maps are not looked at)."""
    return F.xxhash64(*[F.col(f"{of}`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)])


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, _h, _t, _k): words of each row, its place in the shuffled order, its name."""
    return docs.select(
        "doc_id",
        _name(docs).alias("_k"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_h"),
        F.xxhash64("text").alias("_t"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_rows, weight, target): one row per source."""
    one = W.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # one row per source from here on
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(one) - 1) % len(weights))
    per = per.withColumn("weight", w).withColumn("_cap", most * F.col("source_size"))
    fill = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (share * F.sum("source_size").over(whole) - before) / F.sum("weight").over(rest)
    per = per.withColumn("_level", level)
    # the level of the first source, by cap / weight, that does not reach its cap; all capped: the last one
    per = per.withColumn("_no", F.row_number().over(fill))
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct("_no", "_level"))).over(whole)
    per = per.withColumn("_first", F.coalesce(first["_level"], F.max(F.struct("_no", "_level")).over(whole)["_level"]))
    return per.select("source", "source_size", "n_rows", "weight", F.least(F.col("_first") * F.col("weight"), "_cap").alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def placed(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized`` with its source's row and ``offset``: words before it in its source's stream."""
    n_rows = goals.agg(F.sum("n_rows")).first()[0] or 0
    digits = 1
    while 16**digits * CELL < n_rows:
        digits += 1
    cell = F.substring("_h", 1, digits)
    cells = sized.groupBy("source", cell.alias("_c")).agg(F.sum("size").alias("_n"))
    up_to = W.partitionBy("source").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "_c", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_base"))
    g = goals.select(F.col("source").alias("_s"), "source_size", "target", "weight")
    cells = cells.join(g, _same(F.col("source"), F.col("_s"))).select("_s", "_c", "_base", "source_size", "target", "weight")
    inside = W.partitionBy("_s", "_c").orderBy("_h", "doc_id", "_t", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("_cell", cell).join(cells, _same(F.col("source"), F.col("_s")) & (F.col("_cell") == F.col("_c")))
    return rows.withColumn("offset", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("_s", "_cell", "_c", "_base")


def block_words(goals: DataFrame, slots: int = SLOTS) -> int:
    total = goals.agg(F.sum(F.floor("target"))).first()[0] or 0
    return max(LEAST_BLOCK, -(-int(total) // slots))


def n_slots(total: int, least: int, block: int) -> int:
    """Slots of the schedule of ``total`` words whose smallest source gives ``least``."""
    need = -(-total // block)
    return need + min(MOST_SLOTS, SPARE * -(-total // max(1, least))) if need else 0


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(source, block_no, position): the slot of each source's blocks."""
    plays = goals.withColumn("_goal", F.floor("target")).filter("_goal > 0")
    total, least = plays.agg(F.coalesce(F.sum("_goal"), F.lit(0)), F.coalesce(F.min("_goal"), F.lit(1))).first()
    spark = goals.sparkSession
    order = W.orderBy(F.col("source").asc_nulls_last())
    high = F.sum("_goal").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    scale = float(MODULUS) / max(1, total)
    parts = plays.withColumn("_hi", F.floor(high * scale)).withColumn("_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0)))
    n = n_slots(int(total), int(least), block)
    # a point meets its source in an equi-join over 4,096 buckets of the unit interval
    shift = MODULUS >> 12
    bucket = parts.select(F.col("source").alias("_s"), "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / shift), F.floor(F.greatest(F.col("_hi") - 1, "_lo") / shift))).alias("_b"))
    point = (F.col("id") % MODULUS * GOLDEN) % MODULUS
    slots = spark.range(n).withColumn("_u", point).withColumn("_b", F.floor(F.col("_u") / shift))
    owned = slots.join(bucket, "_b").filter("_u >= _lo AND _u < _hi").select("_s", "id")
    # rank of a slot among its source's: counts of earlier chunks of slots, then inside the chunk
    chunk = owned.withColumn("_k", F.floor(F.col("id") / CELL))
    counts = chunk.groupBy("_s", "_k").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_s").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("_s").alias("_s2"), F.col("_k").alias("_k2"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = chunk.join(counts, _same(F.col("_s"), F.col("_s2")) & (F.col("_k") == F.col("_k2"))).withColumn(
        "_rank", F.col("_base") + F.row_number().over(W.partitionBy("_s", "_k").orderBy("id")) - 1
    )
    blocks = plays.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_goal") - 1) / block))).alias("block_no"))
    return blocks.join(ranked, _same(F.col("source"), F.col("_s")) & (F.col("block_no") == F.col("_rank"))).select("source", "block_no", F.col("id").alias("position"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """(source, doc_id, _t, _k, offset, epoch, block_no, start, n_words): what each block takes of each row of ``placed``."""
    goal = F.floor("target")
    epochs = rows.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(MOST) - 1))))
    at = F.col("epoch") * F.col("source_size") + F.col("offset")
    took = epochs.withColumn("_at", at).withColumn("_take", F.least("size", goal - F.col("_at"))).filter("_take > 0")
    cut = took.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_take") - 1) / block))))
    lo = F.greatest(F.col("_at"), F.col("block_no") * block)
    hi = F.least(F.col("_at") + F.col("_take"), (F.col("block_no") + 1) * block)
    return cut.select("source", "doc_id", "_t", "_k", "offset", "epoch", "block_no", (lo - F.col("_at")).alias("start"), (hi - lo).alias("n_words"))


def manifest(docs: DataFrame) -> DataFrame:
    """The mixture: (position, source, block_no, epoch, doc_id, start, n_words), unordered rows.

    ``start`` and ``n_words`` count words of the document; reading by
    position, source, block_no and offset plays the mix.
    """
    sized = write_once(sizes(docs), "sizes")
    goals = write_once(targets(sized), "targets")
    block = block_words(goals)
    cut = pieces(placed(sized, goals), block)
    plan = schedule(goals, block).select(F.col("source").alias("_s"), F.col("block_no").alias("_b"), "position")
    return cut.join(plan, _same(F.col("source"), F.col("_s")) & (F.col("block_no") == F.col("_b"))).select("position", "source", "block_no", "epoch", "doc_id", "_t", "start", "n_words")


def _played(docs: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``placed``, what the slots play of them, summed ``by``: _taken words, first _position)."""
    sized = write_once(sizes(docs), "sizes")
    goals = write_once(targets(sized), "targets")
    block = block_words(goals)
    rows = placed(sized, goals)
    plan = schedule(goals, block).select(F.col("source").alias("_s"), F.col("block_no").alias("_b"), "position")
    played = pieces(rows, block).join(plan, _same(F.col("source"), F.col("_s")) & (F.col("block_no") == F.col("_b")))
    return rows, played.groupBy(*by).agg(F.sum("n_words").alias("_taken"), F.min("position").alias("_position"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position): words that the slots take of every row, and the first such slot."""
    rows, taken = _played(docs, "_k", "_t", "offset")
    out = rows.join(taken, ["_k", "_t", "offset"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.col("_position").alias("position"))


def mixed_documents(docs: DataFrame, position: str | None = None) -> DataFrame:
    """Rows of ``docs`` as the mix plays them, in the order of their first slots: one row per document
    and epoch, its text cut after the words taken where the source's target ends inside it.

    position: name of a column that gets the slot.
    """
    got = write_once(_played(docs, "_k", "_t", "offset", "epoch")[1], "played")
    # of equal rows one is read, and played as often as their places say
    whole = packed(docs).withColumn("_t", F.xxhash64("_row.text")).withColumn("_k", _name(docs, "_row."))
    whole = whole.withColumn("_nth", F.row_number().over(W.partitionBy("_k", "_t").orderBy("_k"))).filter("_nth = 1")
    out = whole.join(got, ["_k", "_t"])
    text, take = F.col("_row.text"), F.col("_taken").cast("int")
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), 0), F.split(text, WORD, -1)
    lead = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), take), F.slice(words, F.lit(1), take), lambda g, w: F.concat(g, w)), "")
    text = F.when(take < F.regexp_count(text, F.lit(WORD)), lead).otherwise(text)
    out = out.withColumn("_row", F.col("_row").withField("text", text)).select("_row", "_position")
    # slots are dealt evenly, so equal ranges of them hold about equal words
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = got.agg(F.max("_position")).first()[0] or 0
    out = out.repartitionById(n, F.floor(F.col("_position") * n / (last + 1)).cast("int")).sortWithinPartitions("_position")
    return unpacked(out) if position is None else out.select("_row.*", F.col("_position").alias(position))
