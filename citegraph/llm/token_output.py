"""Token ids as binary blocks with Elias-Fano document boundaries.

File format: a Parquet table with one row per block (Spark's own commit
protocol covers lost tasks). A block holds whole documents:

- ``shard``, ``block``: place in the id stream; ``first``: ids of the shard's
  earlier blocks; ``n_tokens``: ids of this block;
- ``ids``: the ids end to end, little-endian, ``id_bytes`` wide (2 where the
  vocabulary allows it, else 4);
- ``doc_ids``: the documents' ids, in order;
- ``low_bits``, ``low``, ``high``, ``samples``: the documents' end offsets as
  an Elias-Fano sequence: the low bits packed, the high bits in unary, and the
  position of every 256th one as the start of a select.

Documents are dealt into shards by ranges of doc_id, so shards in order, and
blocks in order inside, give ascending doc_ids.

Edge cases: null and empty texts become the end id alone; a null doc_id comes
first; rows that repeat a doc_id follow each other by their text's hash; an
empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citegraph.llm.store import scratch_path
from citegraph.llm.textscan import LOWER, Texts, chunks

END_ID = 1
#: a block is closed when it has this many ids
BLOCK_IDS = 1 << 18
SAMPLE = 256
#: distinct pieces whose ids a worker keeps (about 40 bytes each)
CACHE = 1_500_000

BLOCKS = "shard int, block int, first long, n_tokens long, id_bytes int, ids binary, doc_ids array<bigint>, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        part = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little")
        return (part >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, whole bytes are skipped by their popcount."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int.from_bytes(self.samples[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        rest = i % SAMPLE
        byte, seen = at // 8, self.high[at // 8] >> (at % 8) << (at % 8)
        while seen.bit_count() <= rest:
            rest -= seen.bit_count()
            byte += 1
            seen = self.high[byte]
        for _ in range(rest):
            seen &= seen - 1
        one = byte * 8 + (seen & -seen).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13, 32]] = True
#: bytes that keep their token whole: contractions, special tokens' first character, odd white space
_WHOLE = np.zeros(256, bool)
_WHOLE[[39, 60, 11, 12]] = True


class Encoder:
    """Encodes texts by pieces, each distinct piece once.

    The vocabulary's normaliser folds case and its pre-tokenizer drops white
    space and never joins ASCII letters with other ASCII characters, so texts
    are cut there (A-Z folded), but for tokens with an apostrophe or ``<``,
    which stay whole. New pieces of ASCII letters go to the BPE model itself,
    new words with other letters are encoded end to end and cut at the ids
    that end a word, all others are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.id_bytes = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.lens, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _new(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        alpha, rest = [], []
        for k, p in enumerate(pieces):
            if p.isascii() and p.isalpha():
                out[k] = [t.id for t in self.tokenizer.model.tokenize(p)]
            else:
                (alpha if p.isalpha() else rest).append(k)
        if alpha:
            ids = np.array(self.tokenizer.encode(" ".join(pieces[k] for k in alpha), add_special_tokens=False).ids)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(alpha):  # every word is one pre-token
                for k, x in zip(alpha, np.split(ids, cuts[:-1])):
                    out[k] = x.tolist()
            else:
                rest += alpha
        for k, e in zip(rest, self.tokenizer.encode_batch([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _learn(self, t: Texts, h, start, end) -> None:
        keys, at = np.unique(h, return_index=True)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            missing = self.keys[near] != keys
            keys, at = keys[missing], at[missing]
        if not len(keys):
            return
        ids = self._new([t.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())])
        lens = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        keys = np.concatenate([self.keys, keys])
        first = np.concatenate([self.first, np.cumsum(lens) - lens + len(self.flat)])
        lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, flat])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.first, self.lens = keys[order], first[order], lens[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; number of ids of each text)."""
        if len(self.keys) > CACHE:
            self._clear()
        t = Texts(texts)
        start, end, doc = t.runs(~_GAP[t.data])
        if not len(start):
            return np.full(t.n, END_ID, np.uint32), np.ones(t.n, np.int64)
        odd = np.concatenate(([0], np.cumsum(_WHOLE[t.data])))
        whole = np.zeros(len(t.data) + 1, np.int8)
        keep = np.flatnonzero(odd[end] > odd[start])
        whole[start[keep]], whole[end[keep]] = 1, -1
        whole[np.intersect1d(start[keep], end[keep])] = 0  # one whole token after another, at a text's edge
        whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
        t.data = np.where(whole, t.data, LOWER[t.data])
        letter, plain = _LETTER[t.data], (t.data < 128) & ~_GAP[t.data] & ~whole
        cut = np.zeros(len(t.data), bool)
        cut[1:] = (letter[1:] != letter[:-1]) & plain[1:] & plain[:-1]
        cut[start] = True
        at = np.flatnonzero(cut)
        token = np.searchsorted(start, at, "right") - 1
        stop = np.minimum(np.append(at[1:], len(t.data)), end[token])
        h = t.hashes(at, stop)
        self._learn(t, h, at, stop)
        where = np.searchsorted(self.keys, h)
        took = self.lens[where]
        ends = np.cumsum(took)
        out = self.flat[np.repeat(self.first[where] - (ends - took), took) + np.arange(ends[-1])]
        counts = np.bincount(doc[token], took, minlength=t.n).astype(np.int64)
        return np.insert(out, np.cumsum(counts), END_ID), counts + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The Python worker's encoder: tasks that share a worker share its pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_blocks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Blocks of the file format, dealt and sorted by doc_id."""

    def run(batches):
        encoder, schema = encoder_of(tokenizer_path), pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, counts, doc_ids = [], [], []

        def closed():
            nonlocal block, first
            flat, n = np.concatenate(ids), np.concatenate(counts)
            ef = EliasFano.of(np.cumsum(n))
            row = [shard, block, first, len(flat), encoder.id_bytes, flat.astype(f"<u{encoder.id_bytes}").tobytes(), [d for x in doc_ids for d in x], ef.low_bits, ef.low, ef.high, ef.samples]
            block, first = block + 1, first + len(flat)
            for x in (ids, counts, doc_ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                got, n = encoder.encode(part.column("text"))
                ids.append(got.astype(f"<u{encoder.id_bytes}"))
                counts.append(n)
                doc_ids.append(part.column("doc_id").to_pylist())
                if sum(map(len, ids)) >= BLOCK_IDS:
                    yield closed()
        if ids:
            yield closed()

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    encode_blocks(docs, tokenizer_path).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row per written shard: as many as the write had partitions
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}")
                ends = EliasFano(len(b["doc_ids"]), b["low_bits"], b["low"], b["high"], b["samples"]).all().tolist()
                wide, start = ids.astype("<u4"), 0
                for doc_id, end in zip(b["doc_ids"], ends):
                    out.append((doc_id, b["base"] + b["first"] + start, end - start, zlib.crc32(wide[start:end])))
                    start = end
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(bases), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer_path)
    return read(docs.sparkSession, path)
