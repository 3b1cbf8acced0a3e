"""N-gram Jaccard join with PartEnum signatures.

A text's set: its distinct shingles of ``SHINGLE`` words; with fewer words the
whole sequence is one. Two sets of sizes a <= b link when their Jaccard
similarity is at least ``percent`` / 100, that is when b <= 100 a / percent and
their symmetric difference is at most (a + b) (100 - percent) / (100 + percent).

Signatures. Sizes fall into bands; a pair is found under the band t of its
smaller set, where the difference is at most k(t). The feature domain is cut
by hash on two levels: into parts, and each part into three cells. Of the
parts in their order a set takes as many as it needs: a part with shingles in
two cells or more is spoilt by two differences at least, one with shingles in
one cell by one, and a set takes parts until spoiling them all would need
k + 1 differences. So in the shorter of two linked sets' lists some part has
one difference at most, and both lists hold it; of its three cells two are
equal, and not both empty. Each set enumerates the subsets of two cells of its
parts; a subset's projection is a signature, under the set's own band and the
bands of smaller partners it can have.

It is enough that one set of a pair has parts enough. A set that has not goes
on to the next of five partitions (``TIERS``), under whose signatures it meets
all others that went on: coarse parts of the rarer shingles, finer parts,
single rarer shingles, then coarse parts with those of common shingles last,
and single shingles, of which every set has more than k. So a passage that
many texts share makes signatures only where a text has little else. Which
shingles count as common is found by counting; it changes the work, and never
the result, which is exact.

Sets are named by a 64-bit hash of their shingles, so exact copies are one
set everywhere. The sets of a signature are not paired with each other: all
are compared with its centre, the one that shares most signatures with others
(the text that near copies were made from), and components of the links found
are merged. Only sets of one centre that are then in different components are
compared pairwise, each pair once a centre, and inside that join parity
bitmaps hold it back: two sets' bitmaps differ in at most as many bits as the
sets in shingles, so too many rule the pair out for certain. What is left is
compared by whole sets.

Edge cases: null and empty texts have no set, size 0 and link with nothing;
repeated rows and repeated doc_ids are rows of their own; a null doc_id is
compared like any other, and a component's id is its smallest doc_id that is
not null; extra columns are ignored, or passed through by
``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citegraph.llm.components import components
from citegraph.llm.store import packed, text_key, unpacked, write_once
from citegraph.llm.suffix_dedup import bit_table
from citegraph.llm.textscan import Texts, chunks, mix, windows

SHINGLE = 5
PERCENT = 80
#: upper over lower size of a band
BAND = 1.4
#: a shingle in this many sets of one task is reported as common
LOCAL_COMMON = 4
#: common shingles that are sent to the tasks, at most (8 bytes each); the most frequent first
MAX_COMMON = 500_000
#: counters that a task keeps while it looks for common shingles
COUNTERS = 2_000_000


def band_table(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Rows (lower, upper, k, parts, largest partner) of the bands up to ``largest``."""
    out, low = [], 1
    while low <= max(1, largest):
        high = max(low, int(low * BAND))
        partner = 100 * high // percent
        k = (high + partner) * (100 - percent) // (100 + percent)
        out.append((low, high, k, 1 + 6 * (k + 1) // 10, partner))
        low = high + 1
    return np.array(out, np.int64)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, text number) of the distinct shingles of each text, sorted by text and hash; number of texts."""
    t = Texts(column, lower=True)
    start, end, doc = t.words()
    h = t.hashes(start, end)
    key, at = windows(h, doc, SHINGLE)
    owner = doc[at]
    n_words = np.bincount(doc, minlength=t.n)
    first = np.cumsum(n_words) - n_words
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(SHINGLE - 1):
            has = n_words[few] > j
            whole[has] = mix(whole[has] + h[first[few[has]] + j] + np.uint64(j + 1))
        key, owner = np.concatenate([key, whole]), np.concatenate([owner, few])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new], t.n


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)


def fingerprints(key: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit name) of each text's set."""
    size = np.bincount(owner, minlength=n)
    name = np.zeros(n, np.uint64)
    has = np.flatnonzero(size)
    name[has] = mix(_sums(mix(key + np.uint64(0x51ED270B)), (np.cumsum(size) - size)[has]) + size[has].astype(np.uint64))
    return size, name.view(np.int64)


#: (parts as a multiple of the band's, None: a part for each shingle; whether common shingles take part)
TIERS = ((1, False), (3, False), (None, False), (1, True), (None, True))
#: cells of a part, and the subsets of them that are enumerated
CELLS = 3
SUBSETS = ((0, 1), (0, 2), (1, 2))


def _subsets(key, owner, late, n, tag, bands, tier: int):
    """(signature, text) of the parts that a set needs, and which texts have too few.

    key: shingle hashes sorted inside a text; late: which of them are common.
    """
    times, with_common = TIERS[tier]
    if not with_common:
        key, owner, late = key[~late], owner[~late], late[~late]
    if times is None:
        part, cell = key >> np.uint64(1), np.zeros(len(key), np.uint64)
    else:
        m = (times * bands[tag, 3][owner]).astype(np.uint64)
        part, cell = ((key >> np.uint64(32)) * m) >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)) % np.uint64(CELLS)
    part = part | (late.astype(np.uint64) << np.uint64(63))
    order = np.lexsort((part, owner)) if with_common else np.arange(len(part))
    p, o, c, v = part[order], owner[order], cell[order], mix(key[order] + np.uint64(0xA5A5A5))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    po, pp = o[first], p[first]
    sums = [_sums(np.where(c == j, v, np.uint64(0)), first) for j in range(CELLS)]
    filled = [_sums((c == j).astype(np.int64), first) > 0 for j in range(CELLS)]
    # differences that it takes to leave a part without an equal subset
    holds = np.minimum(CELLS - len(SUBSETS[0]) + 1, sum(x.astype(np.int64) for x in filled))
    total = np.bincount(po, holds, minlength=n).astype(np.int64)
    before = np.cumsum(holds) - holds
    before -= (np.cumsum(total) - total)[po]
    need = bands[tag, 2] + 1
    taken = before < need[po]
    name = mix(pp) + (tag[po].astype(np.uint64) << np.uint64(8)) + np.uint64(tier)
    sigs, docs = [], []
    for j, subset in enumerate(SUBSETS if times is not None else SUBSETS[:1]):
        ok = np.flatnonzero(taken & np.logical_or.reduce([filled[i] for i in subset]))
        sigs.append(mix(sum(sums[i][ok] for i in subset) + mix(name[ok] + (np.uint64(j) << np.uint64(4)))))
        docs.append(po[ok])
    return np.concatenate(sigs), np.concatenate(docs), total < need


def signatures(key, owner, n, size, common: np.ndarray, bands: np.ndarray):
    """(signature, text number) of all sets under all bands in which they can have partners."""
    sigs, docs = [], []
    own = np.searchsorted(bands[:, 0], size, "right") - 1
    late = _member(key, common)
    back = 0
    while True:
        tag = own - back
        safe = np.maximum(tag, 0)
        meets = (size > 0) & (tag >= 0) & (size <= bands[safe, 4])
        if not meets.any():
            break
        todo = meets & (bands[safe, 2] > 0)  # with k = 0 only equal sets link, and these are one
        for tier in range(len(TIERS)):
            at = todo[owner]
            if not at.any():
                break
            s, d, short = _subsets(key[at], owner[at], late[at], n, safe, bands, tier)
            sigs.append(s)
            docs.append(d)
            todo = todo & short
        back += 1
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(docs)


#: words of 64 bits of the short parity bitmap that the pairing join tests
PARITY = 32
#: sets of a centre that a task pairs with all others of the centre
CENTRE_ROWS = 256


def bitmaps(key: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: every shingle flips one of 2n or more bits (a power of two)."""
    out, at = [], 0
    for n in size.tolist():
        bits = max(64, 1 << (2 * n - 1).bit_length()) if n else 64
        hits = np.bincount((mix(key[at : at + n]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        out.append(np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes())
        at += n
    return out


def parities(key: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """PARITY words of each set: every shingle flips one of their bits."""
    bit = mix(key) & np.uint64(64 * PARITY - 1)
    rows = np.zeros(n * PARITY, np.uint64)
    np.bitwise_xor.at(rows, owner * PARITY + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64)), PARITY).cast(pa.list_(pa.int64()))


def least_difference(a: bytes, b: bytes) -> int:
    """Differing bits of two parity bitmaps, the larger folded to the smaller: at most the sets' differences."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


class _Counter:
    """Counts of frequent values in bounded memory: single ones are dropped when it is full."""

    def __init__(self):
        self.keys, self.counts, self.more, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.more.append(keys)
        self.n += len(keys)
        if self.n > COUNTERS:
            self.merge()

    def merge(self) -> None:
        new, count = np.unique(np.concatenate([*self.more, self.keys[:0]]), return_counts=True)
        keys, counts = np.concatenate([self.keys, new]), np.concatenate([self.counts, count])
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(inverse, counts, minlength=len(self.keys)).astype(np.int64)
        self.more, self.n = [], 0
        if len(self.keys) > COUNTERS // 2:
            keep = self.counts > 1
            self.keys, self.counts = self.keys[keep], self.counts[keep]


def _first_seen(names: np.ndarray, size: np.ndarray, seen: set) -> np.ndarray:
    """Texts whose set this task has not met before."""
    new = np.zeros(len(names), bool)
    for i in np.flatnonzero(size).tolist():
        if names[i] not in seen:
            seen.add(names[i])
            new[i] = True
    return new


def _described(docs: DataFrame) -> DataFrame:
    """(kind 0, doc_id, n, name, tie, bits, parity) of every row, and (kind 1, count, shingle) of locally common shingles."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        counter, seen = _Counter(), set()
        names = ["kind", "doc_id", "n", "name", "tie", "bits", "parity"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in chunks(batch):
                key, owner, n = shingles(part.column("text"))
                size, name = fingerprints(key, owner, n)
                counter.add(key[_first_seen(name, size, seen)[owner]])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(name), part.column("tie"), pa.array(bitmaps(key, size), pa.binary()), parities(key, owner, n)], names=names)
        if id_type is not None:
            counter.merge()
            hot = counter.counts >= LOCAL_COMMON
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(hot.sum(), np.int32)), pa.nulls(int(hot.sum()), id_type), pa.array(counter.counts[hot]), pa.array(counter.keys[hot].view(np.int64)), pa.nulls(int(hot.sum()), pa.int64()), pa.nulls(int(hot.sum()), pa.binary()), pa.nulls(int(hot.sum()), pa.list_(pa.int64()))], names=names)

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("tie"))
    return rows.mapInArrow(run, f"kind int, doc_id {kind.simpleString()}, n long, name long, tie long, bits binary, parity array<long>")


def _signed(docs: DataFrame, common: np.ndarray, largest: int, percent: int) -> DataFrame:
    """(key, name, n): signatures of every set, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # MAX_COMMON hashes

    def run(batches):
        bands, seen = band_table(largest, percent), set()
        for batch in batches:
            for part in chunks(batch):
                key, owner, n = shingles(part.column("text"))
                size, name = fingerprints(key, owner, n)
                new = _first_seen(name, size, seen)
                at = new[owner]
                sig, doc = signatures(key[at], owner[at], n, np.where(new, size, 0), shared.value, bands)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(name[doc])], names=["key", "name"])

    return docs.select("text").mapInArrow(run, "key long, name long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, n, hashes): the sorted shingle hashes of the sets named in ``wanted`` (name, doc_id).

    A bit table of the wanted doc_ids keeps other texts from being cut up; its
    false hits fall away by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("doc_id").alias("key"))))

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = (batch.column("key").to_numpy().view(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            for part in chunks(batch.filter(pa.array(hit.astype(bool)))):
                key, owner, n = shingles(part.column("text"))
                size, name = fingerprints(key, owner, n)
                ends = np.cumsum(size)
                rows = [key[e - k : e].tobytes() for e, k in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(size.astype(np.int64)), pa.array(rows, pa.binary())], names=["name", "n", "hashes"])

    rows = docs.select("text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "name long, n long, hashes binary")
    return rows.join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])


def _both(pairs: DataFrame, table: DataFrame, value: str, percent: int) -> DataFrame:
    """``pairs`` (u, v) with ``value`` of both sets as hu and hv, where their sizes allow a link."""
    left = table.select(F.col("name").alias("u"), F.col("n").alias("nu"), F.col(value).alias("hu"))
    right = table.select(F.col("name").alias("v"), F.col("n").alias("nv"), F.col(value).alias("hv"))
    met = pairs.join(left, "u").join(right, "v").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    return met.select("u", "v", "nu", "nv", "hu", "hv")


def _may_link(n: str, m: str, x: str, y: str, percent: int) -> Column:
    """Whether sizes and parity words of two sets leave a link possible."""
    differ = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(PARITY))
    sizes = f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"
    return F.expr(f"{sizes} AND ({differ}) * {100 + percent} <= ({n} + {m}) * {100 - percent}")


def _kept(batches, test):
    for batch in batches:
        cols = [batch.column(c) for c in ("nu", "nv", "hu", "hv")]
        ok = [test(n, m, x.as_buffer(), y.as_buffer()) for n, m, x, y in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2], cols[3])]
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])


def _possible(pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of set names that their parity bitmaps do not rule out."""
    test = lambda n, m, x, y: least_difference(x, y) * (100 + percent) <= (n + m) * (100 - percent)
    return _both(pairs, owners, "bits", percent).mapInArrow(lambda batches: _kept(batches, test), "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of set names whose similarity is high enough, by whole sets."""
    pairs = write_once(_possible(pairs, owners, percent), "possible-pairs")
    if pairs.isEmpty():
        return pairs
    wanted = write_once(pairs.select(F.explode(F.array("u", "v")).alias("name")).distinct().join(owners.select("name", "doc_id"), "name"), "wanted")
    sets = write_once(_sets(docs, wanted), "shingle-sets")

    def test(n, m, x, y):
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return 100 * both >= percent * (n + m - both)

    return _both(pairs, sets, "hashes", percent).mapInArrow(lambda batches: _kept(batches, test), "u long, v long")


def _stars(signed: DataFrame) -> DataFrame:
    """(center, name): each set with the centres of its signatures; a signature of one set alone is none."""
    same = W.partitionBy("key").orderBy("name")
    seen = signed.select("key", "name", F.lead("name").over(same).alias("_next"), F.first("name").over(same.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_first"))
    # the last row of each name, where there is another name
    seen = seen.filter("(_next IS NULL AND _first != name) OR _next != name").select("key", "name")
    shared = write_once(seen.withColumn("others", F.count(F.lit(1)).over(W.partitionBy("key")) - 1), "shared-signatures")
    weight = shared.groupBy("name").agg(F.sum("others").alias("weight"))
    center = shared.join(weight, "name").groupBy("key").agg(F.max(F.struct("weight", "name"))["name"].alias("center"))
    return shared.join(center, "key").select("center", "name").distinct()


def _near(pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of set names that sizes and parity words do not rule out."""
    left = owners.select(F.col("name").alias("u"), "n", "parity")
    right = owners.select(F.col("name").alias("v"), F.col("n").alias("nv"), F.col("parity").alias("pv"))
    met = pairs.join(left, "u").withColumnRenamed("v", "w").join(right, F.expr("v = w") & _may_link("n", "nv", "parity", "pv", percent))
    return met.select("u", "v")


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of sets of one centre in different components, to be joined by (center, deal).

    A centre with more than ``CENTRE_ROWS`` sets is dealt: each set has one
    deal on the left and all deals on the right, so every pair meets once and
    a task pairs about ``CENTRE_ROWS`` sets with the centre's.
    """
    split = members.groupBy("center").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count(F.lit(1)) / CENTRE_ROWS).alias("deals")).filter("a != b").select("center", "deals")
    held = members.filter("center != name").join(split, "center")
    left = held.withColumn("deal", F.pmod(F.xxhash64("name"), F.col("deals")))
    right = held.withColumn("e", F.explode(F.expr("sequence(0L, deals - 1)")))
    return left, right.select(F.col("center").alias("c"), "e", F.col("name").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("parity").alias("pv"))


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, root) of every row of ``docs``; tie is the text's hash."""
    told = write_once(_described(docs), "sets")
    rows = told.filter("kind = 0").select("doc_id", "n", "name", "tie")
    largest = rows.agg(F.max("n")).first()[0] or 1
    top = told.filter("kind = 1").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(MAX_COMMON)
    common = np.sort(np.array([r["name"] for r in top.select("name").collect()], np.int64).view(np.uint64))
    by_name = told.filter("kind = 0 AND n > 0").groupBy("name")
    owners = write_once(by_name.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("bits").alias("bits"), F.min("parity").alias("parity")), "owners")

    stars = write_once(_stars(_signed(docs, common, largest, percent)), "stars")
    pairs = stars.filter("center != name").select(F.col("center").alias("u"), F.col("name").alias("v"))
    links = write_once(_verified(_near(pairs, owners, percent), docs, owners, percent), "links")
    roots = write_once(components(links), "roots")

    # sets of one centre that are still in different components
    known = owners.select("name", "n", "parity").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    members = write_once(stars.join(known, "name"), "members")
    left, right = _dealt(members)
    near = F.expr("center = c AND deal = e AND root < rv") & _may_link("n", "nv", "parity", "pv", percent)
    rest = left.join(right, near).select(F.least("name", "v").alias("u"), F.greatest("name", "v").alias("v")).distinct()
    more = write_once(_verified(rest, docs, owners, percent), "more-links")
    if not more.isEmpty():
        roots = write_once(components(links.union(more)), "roots")

    named = owners.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", "doc_id", F.coalesce("root", "name").alias("root"))
    named = write_once(named, "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = write_once(named.join(write_once(least, "least"), "root").select(F.col("name").alias("_name"), "component_id", "root"), "component-ids")
    out = rows.join(ids, (F.col("name") == F.col("_name")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), component.alias("component_id"), "root")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest doc_id.

    Rows without words stay. Of rows that repeat the kept doc_id in one
    component, the first by the text's hash stays, and once.
    """
    parts = classes(docs, percent)
    best = parts.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("b"))
    kept = best.select("b.doc_id", "b.tie", F.lit(True).alias("_once"))
    kept = kept.union(parts.filter("n_shingles = 0").select("doc_id", "tie", F.lit(False)).distinct())
    kept = kept.select(F.xxhash64("doc_id", "tie").alias("_k"), F.col("tie").alias("_t"), "_once")
    rows = packed(docs).withColumn("_t", text_key(F.col("_row.text"))).withColumn("_k", F.xxhash64("_row.doc_id", "_t")).join(kept, ["_k", "_t"])
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("_k", "_t").orderBy("_k")))
    return unpacked(rows.filter("_r = 1 OR NOT _once"))
