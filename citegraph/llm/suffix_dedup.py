"""Removal of repeated byte strings by sorted suffixes (deep-shallow sorting).

Every position whose next ``MATCH`` bytes lie inside one text is a suffix. A
suffix repeats when the same ``MATCH`` bytes start earlier: in a smaller
doc_id, or earlier in the same text. All bytes of repeating suffixes go.

1. Dealing. A suffix belongs to its anchor, the gram of ``GRAM`` bytes inside
   its first ``MATCH`` bytes with the smallest hash (the leftmost of equals).
   Equal suffixes have equal anchors, neighbours mostly share one, so a text
   is a row of runs of suffixes with one anchor each.
2. Anchor hashes are counted over all texts; a run whose anchor occurs once
   cannot repeat. The repeated hashes go into a bit table of bounded size,
   whose false hits cost work only.
3. The remaining runs, with the bytes they need, meet by anchor hash. Tasks
   settle their own runs first and send on only the earliest of equal
   suffixes, which keeps a passage of many copies small; then each anchor's
   runs are settled.
4. Settling sorts suffixes deep-shallow: a multikey sort on 8-byte symbols to
   ``SHALLOW`` bytes, then blind tries for what still shares its prefix: every
   member is compared with its group's leader and skips to the symbol where
   it branches off; members that never branch are equal. All but the earliest
   suffix of a leaf are marked.

Edge cases: null and empty texts have no bytes; texts shorter than ``MATCH``
keep all; a null doc_id is smaller than all others; rows that repeat a doc_id
are ordered by their text's hash, exact repeats of a row are one text and each
gets its result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.store import text_key, write_once
from citegraph.llm.textscan import _BYTE, BASE, Texts, chunks, mix

MATCH = 100
GRAM = 32
SHALLOW = 32
#: suffixes that a task sorts at a time
SETTLE = 500_000
#: bits of the table of repeated anchors: 16 a hash, between these powers of two
LEAST_BITS, MOST_BITS = 20, 30
_LOW = np.uint64((1 << 28) - 1)
_DEEP = [*range(SHALLOW, MATCH - 8, 8), MATCH - 8]


def runs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text number, first, last) of the runs of suffixes with one anchor; places in ``t.data``."""
    none = np.zeros(0, np.int64)
    n = len(t.data) - MATCH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    g, size, power = _BYTE[t.data], 1, BASE
    while size < GRAM:
        g = g[:-size] * np.uint64(power) + g[size:]
        size, power = 2 * size, power * power % (1 << 64)
    g = mix(g)
    low = (g & ~_LOW) | (np.arange(len(g), dtype=np.uint64) & _LOW)
    width = MATCH - GRAM + 1
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n], low[width - span : width - span + n])
    at = np.arange(n)
    anchor = at + ((low & _LOW).astype(np.int64) - at) % (1 << 28)
    edge = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(t.off[1:] - t.off[:-1] >= MATCH)
    np.add.at(edge, t.off[long], 1)
    np.add.at(edge, np.minimum(n, t.off[long + 1] - MATCH + 1), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return g[a[first]], t.doc_of(at[first]), at[first], at[last]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group number in that order, group sizes) of equal keys, the first key most significant."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.cumsum(new)
    return order, number, np.bincount(number) if len(order) else np.zeros(0, np.int64)


def equal_suffixes(data: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix index, class) of the suffixes at ``pos`` whose first MATCH bytes occur at least twice."""
    word = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | data[j : len(data) - 7 + j]
    idx, group = np.arange(len(pos)), None
    for depth in range(0, SHALLOW, 8):  # multikey: one 8-byte symbol at a time inside the groups so far
        w = word[pos[idx] + depth]
        order, number, size = _groups(w) if group is None else _groups(group, w)
        keep = size[number] > 1
        idx, group = idx[order[keep]], number[keep]
    out_idx, out_class, classes = [], [], 0
    while len(idx):  # idx is sorted by group: blind tries, one level of branches at a time
        new = np.ones(len(idx), bool)
        new[1:] = group[1:] != group[:-1]
        leader = idx[np.flatnonzero(new)][np.cumsum(new) - 1]
        branch = np.full(len(idx), -1)
        open_ = np.arange(len(idx))
        for k, depth in enumerate(_DEEP):
            differ = word[pos[idx[open_]] + depth] != word[pos[leader[open_]] + depth]
            branch[open_[differ]] = k
            open_ = open_[~differ]
        leaf = branch < 0
        number = np.cumsum(new) - 1
        size = np.bincount(number[leaf], minlength=number[-1] + 1)
        twice = leaf & (size[number] > 1)
        out_idx.append(idx[twice])
        out_class.append(number[twice] + classes)
        classes += int(number[-1]) + 1
        rest = np.flatnonzero(~leaf)
        w = word[pos[idx[rest]] + np.array(_DEEP)[branch[rest]]]
        order, number, size = _groups(number[rest], branch[rest], w)
        keep = size[number] > 1
        idx, group = idx[rest[order[keep]]], number[keep]
    return (np.concatenate(out_idx), np.concatenate(out_class)) if out_idx else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Rows:
    """Runs with their bytes: (anchor, did, tie, start, bytes from start to the last suffix's end)."""

    def __init__(self, key, did, tie, start, data, off):
        self.key, self.did, self.tie, self.start, self.data, self.off = key, did, tie, start, data, off

    @classmethod
    def cut(cls, key, did, tie, start, data, lo, hi):
        """Rows of the bytes lo..hi of ``data``, copied end to end."""
        size = hi - lo
        off = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(lo - off[:-1], size) + np.arange(off[-1])
        return cls(key, did, tie, start, data[at], off)

    @classmethod
    def joined(cls, parts):
        cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
        sizes = np.concatenate([np.diff(p.off) for p in parts])
        return cls(cat("key"), cat("did"), cat("tie"), cat("start"), cat("data"), np.concatenate(([0], np.cumsum(sizes))))

    def __len__(self):
        return len(self.key)

    def suffixes(self) -> int:
        return int(self.off[-1]) - (MATCH - 1) * len(self)

    def settle(self):
        """(marks (did, tie, lo, hi), rows of the earliest suffixes)."""
        many = np.diff(self.off) - (MATCH - 1)
        row = np.repeat(np.arange(len(self)), many)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        pos, place = self.off[row] + inner, self.start[row] + inner
        idx, group = equal_suffixes(self.data, pos)
        order = np.lexsort((place[idx], self.tie[row[idx]], self.did[row[idx]], group))
        idx, group = idx[order], group[order]
        state = np.zeros(len(row), np.int8)  # 0 earliest, 1 repeats, 2 the same place as the earliest
        if len(idx):
            new = np.ones(len(idx), bool)
            new[1:] = group[1:] != group[:-1]
            first = idx[np.flatnonzero(new)][np.cumsum(new) - 1]
            same = (self.did[row[idx]] == self.did[row[first]]) & (self.tie[row[idx]] == self.tie[row[first]]) & (place[idx] == place[first])
            state[idx] = np.where(same, np.where(idx == first, 0, 2), 1)

        def pieces(value):
            ok = state == value
            begin, end = ok.copy(), ok.copy()
            if len(ok):
                begin[1:] &= ~ok[:-1] | (row[1:] != row[:-1])
                end[:-1] &= ~ok[1:] | (row[1:] != row[:-1])
            return np.flatnonzero(begin), np.flatnonzero(end)

        b, e = pieces(1)
        marks = (self.did[row[b]], self.tie[row[b]], place[b], place[e] + MATCH)
        b, e = pieces(0)
        left = Rows.cut(self.key[row[b]], self.did[row[b]], self.tie[row[b]], place[b], self.data, pos[b], pos[e] + MATCH)
        return marks, left

    def only(self, ok: np.ndarray) -> Rows:
        at = np.flatnonzero(ok)
        return Rows.cut(self.key[at], self.did[at], self.tie[at], self.start[at], self.data, self.off[at], self.off[at + 1])


_OUT = "key long, did long, tie long, lo long, hi long, bytes binary"
_NAMES = ["key", "did", "tie", "lo", "hi", "bytes"]


def _marked(marks) -> pa.RecordBatch:
    did, tie, lo, hi = marks
    return pa.RecordBatch.from_arrays([pa.nulls(len(did), pa.int64()), pa.array(did), pa.array(tie), pa.array(lo), pa.array(hi), pa.nulls(len(did), pa.binary())], names=_NAMES)


def _sent(r: Rows) -> pa.RecordBatch:
    data = pa.Array.from_buffers(pa.large_binary(), len(r), [None, pa.py_buffer(r.off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(r.data))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(r.key.view(np.int64)), pa.array(r.did), pa.array(r.tie), pa.array(r.start), pa.nulls(len(r), pa.int64()), data], names=_NAMES)


def _received(batch: pa.RecordBatch) -> Rows:
    col = batch.column("bytes").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    num = lambda c: batch.column(c).to_numpy()
    return Rows(num("key").view(np.uint64), num("did"), num("tie"), num("lo"), data, off - off[0])


def _slices(r: Rows, limit: int):
    """Consecutive parts of ``r`` with about ``limit`` suffixes."""
    ends = np.cumsum(np.diff(r.off) - (MATCH - 1))
    at = 0
    while at < len(r):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield Rows(r.key[at:stop], r.did[at:stop], r.tie[at:stop], r.start[at:stop], r.data[r.off[at] : r.off[stop]], r.off[at : stop + 1] - r.off[at])
        at = stop


def _repeated_anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                key, count = np.unique(runs(Texts(part.column("text")))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")


def bit_table(keys: DataFrame) -> np.ndarray:
    """A bit for every hash, indexed by its low bits; at most 2 ** MOST_BITS bits."""
    n = keys.count()
    power = int(np.clip((16 * n).bit_length(), LEAST_BITS, MOST_BITS))

    def bits(table):
        b = np.zeros(1 << 16, np.uint8)
        b[table.column("bit").to_numpy()] = 1
        return pa.table({"page": table.column("page")[:1], "bits": pa.array([np.packbits(b).tobytes()])})

    low = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    pages = keys.select((F.shiftright(low, 16)).alias("page"), low.bitwiseAND(F.lit((1 << 16) - 1)).alias("bit")).distinct()
    out = np.zeros(1 << (power - 3), np.uint8)
    # written before it is iterated: over a shuffle the iterator runs a job for each partition
    for r in write_once(pages.groupBy("page").applyInArrow(bits, "page long, bits binary"), "bit-pages").toLocalIterator():
        out[r["page"] << 13 : (r["page"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Runs with repeated anchors; each task's own repeats are settled already."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = shared.value
        mask, held = np.uint64(8 * len(bits) - 1), []
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                t = Texts(part.column("text"))
                key, doc, first, last = runs(t)
                at = (key & mask).astype(np.int64)
                ok = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
                doc, first, last = doc[ok], first[ok], last[ok]
                did, tie = (part.column(c).to_numpy()[doc] for c in ("did", "tie"))
                held.append(Rows.cut(key[ok], did, tie, first - t.off[doc], t.data, first, last + MATCH))
                if sum(h.suffixes() for h in held) >= SETTLE:
                    for piece in _slices(Rows.joined(held), SETTLE):
                        marks, left = piece.settle()
                        yield _marked(marks)
                        yield _sent(left)
                    held = []
        if held:
            marks, left = Rows.joined(held).settle()
            yield _marked(marks)
            yield _sent(left)

    return docs.select("did", "tie", "text").mapInArrow(run, _OUT)


def _settled(rows: DataFrame) -> DataFrame:
    """Marks of the runs that meet by anchor; ``rows`` is sorted by key."""

    def run(batches):
        held = None
        for batch in batches:
            for r in _slices(_received(batch), SETTLE):
                held = r if held is None else Rows.joined([held, r])
                if held.suffixes() >= SETTLE:
                    marks, left = held.settle()
                    yield _marked(marks)
                    # only the last anchor can have more to come
                    held = left.only(left.key == held.key[-1])
        if held is not None and len(held):
            yield _marked(held.settle()[0])

    return rows.mapInArrow(run, _OUT)


def marks(docs: DataFrame) -> DataFrame:
    """(did, tie, lo, hi): byte ranges of repeats; ranges of one text may overlap. docs: (did, tie, text)."""
    table = bit_table(write_once(_repeated_anchors(docs), "anchors"))
    first = write_once(_candidates(docs, table), "runs")
    sent = first.filter("key IS NOT NULL").repartition("key").sortWithinPartitions("key")
    return first.filter("key IS NULL").select("did", "tie", "lo", "hi").union(_settled(sent).select("did", "tie", "lo", "hi"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, did, tie): the order of texts is that of (did, tie)."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select("doc_id", "text", did.alias("did"), text_key(F.col("text")).alias("tie"))


def _union(lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by the ranges lo..hi (touching ones join)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, lo, hi, kept): removed ranges and remaining bytes of every text."""
    rows = keyed(docs)
    ranges = marks(rows).groupBy("did", "tie").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    met = rows.join(ranges, ["did", "tie"], "left").select("doc_id", "text", "lo", "hi")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                n_bytes, los, his, kept = [], [], [], []
                for text, lo, hi in zip(part.column("text"), part.column("lo"), part.column("hi")):
                    data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                    n_bytes.append(len(data))
                    if lo.is_valid:
                        a, b = _union(lo.values.to_numpy(), hi.values.to_numpy())
                    else:
                        a = b = np.zeros(0, np.int64)
                    los.append(a)
                    his.append(b)
                    cuts = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
                    kept.append(b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(los, pa.list_(pa.int64())), pa.array(his, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "lo", "hi", "kept"])

    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, lo array<long>, hi array<long>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate(F.zip_with("hi", "lo", lambda h, l: h - l), F.lit(0).cast("long"), lambda a, x: a + x)  # noqa: E741
    return dedup(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("lo").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
