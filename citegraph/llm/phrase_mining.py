"""Collocations of two and three words by an FM-index for each shard.

Texts are cut into pieces at punctuation and line ends, pieces into words. A
shard is some megabytes of text of one language: its words are numbered, and
its pieces, each ended by a separator, are indexed forwards and backwards by
their Burrows-Wheeler transforms. Patterns are synchronised intervals of both
indexes: rows of the forward one that start with the pattern and rows of the
backward one that start with it reversed. Extending to the left takes the
symbols of the forward transform inside the interval, extending to the right
those of the backward one; an interval's width is the pattern's count. Since
patterns end at ``MAX_WORDS`` words, rows need no deeper order than
``MAX_WORDS - 1`` words, which makes each index one sort.

Counts are summed across shards, depth by depth. A phrase that occurs often
enough has parts that do, so each depth extends only patterns whose parts are
in the depth before: the frequent words, then the frequent pairs, as a bit
table of bounded size (``suffix_dedup.MOST_BITS``). A false hit of the table
makes a count that its sum removes; nothing that is frequent is missed. Counts
travel as arrays, one row for each shard and range of pattern keys, and a task
adds those of a range; a pattern that is everywhere is one number a shard.

Scores come from joins of the frequent phrases with their parts, in decimals
(exact: products pass 64 bits). The result is the first ``keep`` phrases of a
language, first among parts of the candidates, then among those.

Words and pairs are told apart by 64-bit hashes.

Edge cases: a null text is empty, a null lang is ``und``; only A-Z are folded;
pieces of one word have no phrases; rows that repeat a doc_id count each for
itself, also with a null id; ties follow the phrase's UTF-8 bytes; an empty
table gives no rows; extra columns are ignored; one text longer than a shard
is a shard of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citegraph.llm.store import scratch_path, write_once
from citegraph.llm.suffix_dedup import bit_table
from citegraph.llm.textscan import BASE, Texts, chunks, mix

LEAST, KEEP, OVERLAP = 10, 2000, 50
MAX_WORDS = 3
#: bytes of text of a shard, about 20 times as much memory while it is sorted
SHARD_BYTES = 4 << 20
#: counts of a range of keys that one task adds, at most
RANGE = 2_000_000
#: parts that a language's candidates are ranked in before they meet
PARTS = 64

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

SHARDS = "lang string, n_words long, hashes binary, words array<string>, counts array<int>, forward binary, backward binary"
_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
_NAMES = [f.split()[0] for f in SHARDS.split(", ")]


def transform(symbols: np.ndarray) -> np.ndarray:
    """Symbol before each row, rows in the order of their first MAX_WORDS - 1 symbols."""
    key = symbols.astype(np.uint64)
    for _ in range(MAX_WORDS - 2):
        key = key << np.uint64(32) | np.roll(symbols, -1)
    return symbols[np.argsort(key, kind="stable") - 1]


class Intervals:
    """Patterns: their words (one column a word), and their rows in both indexes."""

    def __init__(self, words: np.ndarray, forward: np.ndarray, backward: np.ndarray, width: np.ndarray):
        self.words, self.forward, self.backward, self.width = words, forward, backward, width

    def only(self, ok: np.ndarray) -> Intervals:
        return Intervals(self.words[ok], self.forward[ok], self.backward[ok], self.width[ok])


class FMIndex:
    """Both transforms of a shard; symbol 0 ends a piece, words are 1, 2, ..."""

    def __init__(self, n_words: int, forward: np.ndarray, backward: np.ndarray):
        self.forward, self.backward = forward, backward
        counts = np.bincount(forward, minlength=n_words + 1)
        #: first row of each symbol, the same in both indexes
        self.first = np.cumsum(counts) - counts
        self.counts = counts

    @classmethod
    def of(cls, symbols: np.ndarray, n_words: int) -> FMIndex:
        return cls(n_words, transform(symbols), transform(symbols[::-1]))

    def words(self) -> Intervals:
        at = np.arange(1, len(self.counts))
        return Intervals(at[:, None], self.first[1:], self.first[1:], self.counts[1:])

    def _extend(self, before: np.ndarray, rows: np.ndarray, other: np.ndarray, width: np.ndarray, allowed: np.ndarray):
        """(pattern, symbol, its rows, the other index's rows, width) of the extensions by allowed symbols."""
        total = int(width.sum())
        at = np.repeat(rows - (np.cumsum(width) - width), width)
        at += np.arange(total)
        key = np.repeat(np.arange(len(width)) << 32, width)
        key |= before[at]
        del at
        key.sort()  # by pattern, then symbol
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else np.zeros(0, np.int64)
        n = np.diff(np.append(new, total))
        pattern, symbol = key[new] >> 32, key[new] & 0xFFFFFFFF
        # smaller symbols of the pattern come before in the other index
        theirs = other[pattern] + new - (np.cumsum(width) - width)[pattern]
        ok = allowed[symbol]
        return pattern[ok], symbol[ok], theirs[ok], n[ok]

    def _rank(self, before: np.ndarray, rows: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the given row."""
        order = before.astype(np.int64) << 32
        order |= np.arange(len(before))
        order.sort()
        return np.searchsorted(order, symbol << 32 | rows) - self.first[symbol]

    def left(self, p: Intervals, allowed: np.ndarray) -> Intervals:
        """Patterns with one allowed word more in front."""
        pattern, symbol, backward, width = self._extend(self.forward, p.forward, p.backward, p.width, allowed)
        forward = self.first[symbol] + self._rank(self.forward, p.forward[pattern], symbol)
        return Intervals(np.column_stack((symbol, p.words[pattern])), forward, backward, width)

    def right(self, p: Intervals, allowed: np.ndarray) -> Intervals:
        """Patterns with one allowed word more at the end."""
        pattern, symbol, forward, width = self._extend(self.backward, p.backward, p.forward, p.width, allowed)
        backward = self.first[symbol] + self._rank(self.backward, p.backward[pattern], symbol)
        return Intervals(np.column_stack((p.words[pattern], symbol)), forward, backward, width)

    def count_right(self, p: Intervals, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, counts) of the patterns with one allowed word more at the end, without their intervals."""
        pattern, symbol, _, width = self._extend(self.backward, p.backward, p.forward, p.width, allowed)
        return np.column_stack((p.words[pattern], symbol)), width


class _Shard:
    """Words of some texts of one language until they are indexed."""

    def __init__(self):
        self.hashes, self.ends, self.known, self.spelled = [], [], [], []

    def add(self, column: pa.Array) -> None:
        t = Texts(column, lower=True)
        start, end, doc = t.runs(~(_GAP | _CUT)[t.data])
        if not len(start):
            return
        cuts = np.concatenate(([0], np.cumsum(_CUT[t.data], dtype=np.int32)))
        last = np.ones(len(start), bool)  # of its piece
        last[:-1] = (cuts[start[1:]] != cuts[end[:-1]]) | (doc[1:] != doc[:-1])
        h = t.hashes(start, end)
        known, at = np.unique(h, return_index=True)
        self.hashes.append(h)
        self.ends.append(last)
        self.known.append(known)
        self.spelled.append(pa.array([t.data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist())], pa.binary()).cast(pa.string()))

    def row(self, lang: str) -> list | None:
        if not self.hashes:
            return None
        known, at = np.unique(np.concatenate(self.known), return_index=True)
        words = pa.concat_arrays(self.spelled).take(pa.array(at))
        h, last = np.concatenate(self.hashes), np.concatenate(self.ends)
        symbols = np.zeros(len(h) + int(last.sum()), np.uint32)
        symbols[np.arange(len(h)) + np.cumsum(last) - last] = np.searchsorted(known, h) + 1
        index = FMIndex.of(symbols, len(known))
        return [lang, len(h), known.tobytes(), words, index.counts[1:].astype(np.int32), index.forward.tobytes(), index.backward.tobytes()]


def index_shards(docs: DataFrame) -> DataFrame:
    """One row for each shard of each language: its words and both transforms, written once."""

    def closed(shards):
        for lang, shard in shards.items():
            row = shard.row(lang)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v], k) if k != _KINDS[3] else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v, k in zip(row, _KINDS)], names=_NAMES)

    def run(batches):
        shards, size = {}, 0
        for batch in batches:
            for part in chunks(batch):
                langs = pc.fill_null(part.column("lang"), "und")
                for lang in pc.unique(langs).to_pylist():
                    shards.setdefault(lang, _Shard()).add(part.column("text").filter(pc.equal(langs, lang)))
                size += part.column("text").nbytes
                if size >= SHARD_BYTES:
                    yield from closed(shards)
                    shards, size = {}, 0
        yield from closed(shards)

    path = scratch_path(docs.sparkSession, "fm-index")
    docs.select("lang", "text").mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def _seed(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode()) + 1], np.uint64))[0]


def pattern_key(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Key of a pattern of word hashes in the bit tables."""
    key = np.full(len(hashes[0]), _seed(lang), np.uint64)
    for h in hashes:
        key = mix(key * np.uint64(BASE) + h)
    return key


def summed(found: DataFrame, size: int, least: int, name: str) -> DataFrame:
    """(lang, h1, ..., n, word, key): the patterns of ``size`` words that all shards together hold ``least`` times.

    found: rows of ``_sent``, one for each shard and range of keys. A range's
    rows meet in one task, which adds its counts.
    """

    def add(table):
        hashes, keys = [[] for _ in range(size)], []
        for row in _rows(table.to_batches()):
            parts = [np.frombuffer(x, np.uint64) for x in np.split(np.frombuffer(row["hashes"], np.uint64), size)]
            keys.append(pattern_key(row["lang"], parts))
            for x, part in zip(hashes, parts):
                x.append(part)
        sent = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        keys, counts = np.concatenate(keys), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.add.reduceat(counts, first)
        at = order[first[n >= least]]
        words = pc.list_flatten(pc.split_pattern(table.column("words").combine_chunks(), "\n")).take(pa.array(at)) if size == 1 else pa.nulls(len(at), pa.string())
        columns = [pa.array(np.concatenate(x)[at].view(np.int64)) for x in hashes]
        return pa.table([table.column("lang").combine_chunks().take(pa.array(sent[at])), *columns, pa.array(n[n >= least]), words, pa.array(keys[first[n >= least]].view(np.int64))], names=names)

    names = ["lang", *(f"h{k + 1}" for k in range(size)), "n", "word", "key"]
    schema = ", ".join(f"{c} {'string' if c in ('lang', 'word') else 'long'}" for c in names)
    return write_once(found.groupBy("range").applyInArrow(add, schema), name)


SENT = "range int, lang string, hashes binary, counts binary, words string"


def _sent(ranges: int, lang: str, hashes: list[np.ndarray], counts: np.ndarray, words: pa.Array | None = None) -> pa.RecordBatch:
    """A shard's patterns as one row for each range of keys: word hashes column by column, counts, spelled words."""
    where = ((pattern_key(lang, hashes) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((hashes[0], where))
    full, start = np.unique(where[order], return_index=True)
    parts = np.split(order, start[1:]) if len(order) else []
    columns = [
        pa.array(full, pa.int32()),
        pa.array([lang] * len(full), pa.string()),
        pa.array([b"".join(h[p].tobytes() for h in hashes) for p in parts], pa.binary()),
        pa.array([counts[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
        pa.array(["\n".join(words.take(pa.array(p)).to_pylist()) if words is not None else None for p in parts], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SENT.split(", ")])


def _rows(batches):
    """Rows one by one as dicts; binary values stay buffers, lists stay Arrow arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                kind, value = column.type, column[k]
                row[name] = value.as_buffer() if pa.types.is_binary(kind) else value.values if pa.types.is_list(kind) else value.as_py()
            yield row


class _Bits:
    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self.mask).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _loaded(row: dict) -> tuple[str, np.ndarray, FMIndex]:
    h = np.frombuffer(row["hashes"], np.uint64)
    return row["lang"], h, FMIndex(len(h), *(np.frombuffer(row[c], np.uint32) for c in ("forward", "backward")))


def _pairs(row: dict, words: _Bits) -> tuple[str, np.ndarray, FMIndex, Intervals]:
    """(lang, hashes, index, pairs of frequent words) of a shard."""
    lang, h, index = _loaded(row)
    allowed = np.concatenate(([False], words.has(pattern_key(lang, [h]))))
    return lang, h, index, index.left(index.words().only(allowed[1:]), allowed)


def _hashes(h: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    return [h[words[:, j] - 1] for j in range(words.shape[1])]


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to counts of 10 ** 15."""
    d = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    return F.expr(f"CAST((1000000 * {d(a)} * {d(a)}) div ({d(left)} * {d(right)}) AS BIGINT)")


class Phrases:
    """Frequent words, pairs and triples of the documents, by language.

    ``words``: (lang, h1, n, word, key); ``pairs``: (lang, h1, h2, n, ...);
    ``triples``: (lang, h1, h2, h3, n, ...); ``sizes``: (lang, total) with all
    words' occurrences.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST):
        spark = docs.sparkSession
        shards = index_shards(docs)
        self.sizes = write_once(shards.groupBy("lang").agg(F.sum("n_words").alias("total")), "sizes")
        n = self.sizes.agg(F.sum("total")).first()[0] or 0
        # a depth has no more counts than words
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))

        def one(batches):
            for row in _rows(batches):
                yield _sent(ranges, row["lang"], [np.frombuffer(row["hashes"], np.uint64)], row["counts"].to_numpy(), row["words"])

        self.words = summed(shards.select("lang", "hashes", "counts", "words").mapInArrow(one, SENT), 1, least, "words")
        index = shards.select("lang", "hashes", "forward", "backward")
        tables = spark.sparkContext.broadcast([bit_table(self.words.select("key"))])

        def two(batches, shared=tables):
            for row in _rows(batches):
                lang, h, _, pairs = _pairs(row, _Bits(shared.value[0]))
                yield _sent(ranges, lang, _hashes(h, pairs.words), pairs.width)

        self.pairs = summed(index.mapInArrow(two, SENT), 2, least, "pairs")
        tables = spark.sparkContext.broadcast([*tables.value, bit_table(self.pairs.select("key"))])

        def three(batches, shared=tables):
            words, frequent = (_Bits(b) for b in shared.value)
            for row in _rows(batches):
                lang, h, index, pairs = _pairs(row, words)
                pairs = pairs.only(frequent.has(pattern_key(lang, _hashes(h, pairs.words))))
                last = np.zeros(len(h) + 1, bool)
                last[pairs.words[:, 1]] = True
                triples, n = index.count_right(pairs, last)
                ok = frequent.has(pattern_key(lang, _hashes(h, triples[:, 1:])))
                yield _sent(ranges, lang, _hashes(h, triples[ok]), n[ok])

        self.triples = summed(index.mapInArrow(three, SENT), 3, least, "triples")

    def candidates(self) -> DataFrame:
        """(lang, phrase, n_words, a, l, r, score): phrases with the lower cut's parts and score."""
        word = lambda k: self.words.select("lang", F.col("h1").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"f{k}"))
        pair = lambda x, y: self.pairs.select("lang", F.col("h1").alias(f"h{x}"), F.col("h2").alias(f"h{y}"), F.col("n").alias(f"f{x}{y}"))
        two = pair(1, 2).join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).withColumn("a", F.col("f12"))
        two = two.select("lang", "h1", "h2", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.lit(2).alias("n_words"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
        three = self.triples.select("lang", "h1", "h2", "h3", F.col("n").alias("a")).join(pair(1, 2), ["lang", "h1", "h2"]).join(pair(2, 3), ["lang", "h2", "h3"])
        for k in (1, 2, 3):
            three = three.join(word(k), ["lang", f"h{k}"])
        first, second = score("a", "f1", "f23"), score("a", "f12", "f3")
        three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.lit(3).alias("n_words"), "a", "f1", "f23", "f12", "f3", first.alias("s1"), second.alias("s2"))
        low = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
        three = three.select("lang", "phrase", "n_words", "a", low("f1", "f12").alias("l"), low("f23", "f3").alias("r"), F.least("s1", "s2").alias("score"))
        return self._not_inside(two).unionByName(three)

    def _not_inside(self, two: DataFrame, overlap: int = OVERLAP) -> DataFrame:
        """Pairs that no triple holds in ``overlap`` percent of their places or more."""
        part = lambda x, y: self.triples.select("lang", F.col(f"h{x}").alias("h1"), F.col(f"h{y}").alias("h2"), "n")
        longest = part(1, 2).union(part(2, 3)).groupBy("lang", "h1", "h2").agg(F.max("n").alias("longer"))
        free = F.coalesce(100 * F.col("longer") < overlap * F.col("a"), F.lit(True))
        return two.join(longest, ["lang", "h1", "h2"], "left").filter(free).drop("h1", "h2", "longer")

    def top(self, keep: int = KEEP) -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score) of each language's best ``keep``."""
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
        rows = self.candidates().withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        rows = rows.withColumn("_no", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_no") <= keep)
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= keep)
        # one row a language
        rows = rows.join(self.sizes, "lang")
        return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def digest(docs: DataFrame) -> DataFrame:
    return Phrases(docs).top()
