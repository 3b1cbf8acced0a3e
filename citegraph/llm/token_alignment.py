"""Alignment of two tokenizers: which ids of B cover the bytes of an id of A.

Tokenizer A (byte-level BPE, a ``tokenizers`` file) encodes a space and the
text, B (a ``sentencepiece`` model that adds the space itself) the text. Byte
offsets where tokens of both end cut them into groups; tokens whose byte
ranges overlap are linked. An id pair's count is the number of documents that
hold it linked.

Identity-map fast path: an array gives for every A id the B id with the same
bytes. Pairs that agree with it (all exact one-to-one groups) are counted in a
vector as long as A's vocabulary, one for each task, and vectors are added.
Only the other pairs, of irregular groups, become rows. Such rows are made for
blocks of some megabytes of text, each pair once a block with its number of
documents, so that a pair which every document holds is one row a block; the
counts come back to the blocks by a join on the pair. Each text is encoded
once; blocks keep the distinct links of their documents.

Memory: one block with its links for each task, and vectors of the size of
A's vocabulary on the driver.

Edge cases: texts that are null, empty, or whose tokens' bytes are not the
space and the text (characters that B's normaliser changes) have no tokens
and give zeros and an empty digest; special tokens' strings are plain text;
rows that repeat a doc_id, also with a null one, are documents of their own;
an empty table gives no rows; extra columns are ignored. A text longer than a
block is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.store import write_once
from citegraph.llm.textscan import chunks

#: a block is closed when it has this many bytes of text
BLOCK_BYTES = 4 << 20
#: bytes of text that are encoded and cut at a time
CHUNK_BYTES = 1 << 20
#: ids of a slice of the count vectors
SLICE = 4096
#: what the byte-level pre-tokenizer splits by (fixed value)
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_FIELDS = [
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("groups_sha256", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("n_refs", pa.list_(pa.int32())), ("refs", pa.binary()), ("times", pa.binary()),
    ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int32())), ("vector", pa.binary()),
]
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}
BLOCKS = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _FIELDS)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in characters of the byte-level vocabulary and the bytes they mean."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of a text, bytes of an id.

    A plain byte-level BPE whose ids follow its merges runs in ``tiktoken``,
    built from the same file; any other one in ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        pre = spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        in_order = all(vocab.get(x + y) == 256 + k for k, (x, y) in enumerate(merges)) and len(vocab) == 256 + len(merges)
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if in_order and plain:
            import tiktoken

            self._one = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={}).encode_ordinary
            self._many = None
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._many = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._many(texts) if self._many else [self._one(t) for t in texts]


class Pieces:
    """Tokenizer B: ids of a text, bytes of an id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, ids = [], range(self._model.get_piece_size())
        #: ids that no plain text is cut into, but where a character has no piece
        self.spare = [self._model.is_byte(i) or self._model.is_control(i) or self._model.is_unknown(i) for i in ids]
        for i in ids:
            piece = self._model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, the identity map, and the tables that spell groups."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(self.n_b), key=self.b.spare.__getitem__):  # a character's own piece before its byte
            by_bytes.setdefault(self.b.bytes[i], i)
        #: A id -> B id with the same bytes, -1 without one
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a.bytes], np.int64)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        ends = lambda n, last: [f"{i}{c}" for i in range(n) for c in (",", last)]
        self.spelled = np.array(ends(self.n_a, "|") + ends(self.n_b, ";"), object)

    def encode(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of A and of B of each text, both empty where a text has no tokens."""
        texts = [t or "" for t in texts]
        a, b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        at, bt = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for k, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join(map(at, a[k])) != want or b"".join(map(bt, b[k])) != want:
                a[k], b[k] = [], []
        return a, b


class Cut:
    """Groups and links of some texts' tokens."""

    def __init__(self, pair: Pair, a: list[list[int]], b: list[list[int]]):
        flat = lambda x: np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x)))
        self.pair, self.n = pair, len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        ids_a, ids_b = flat(a), flat(b)
        end_a, end_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
        mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        ends = np.flatnonzero(mark)
        mark = mark[ends]
        is_a, is_b, both = mark & 1, mark >> 1, mark == 3
        # a stretch between two ends lies in one token of A and one of B
        at_a, at_b = np.cumsum(is_a, dtype=np.int64) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b
        self.a, self.b = ids_a[at_a], ids_b[at_b]
        self.doc = np.repeat(np.arange(self.n), self.n_a)[at_a]
        self.n_links = np.bincount(self.doc, minlength=self.n)
        self.n_groups = np.bincount(self.doc[both], minlength=self.n)
        self._order(ids_a, ids_b, is_a, is_b, both)

    def _order(self, ids_a, ids_b, is_a, is_b, both) -> None:
        """Place of every token in the spelled groups: a group's A ids, then its B ids."""
        group = np.cumsum(both, dtype=np.int64) - both
        closed = np.flatnonzero(both)
        up_to_a, up_to_b = (np.concatenate(([0], np.cumsum(x, dtype=np.int64)[closed])) for x in (is_a, is_b))
        pos_a, pos_b = np.flatnonzero(is_a), np.flatnonzero(is_b)
        self._tokens = np.empty(len(ids_a) + len(ids_b), np.int64)
        self._tokens[np.arange(len(ids_a)) + up_to_b[group[pos_a]]] = ids_a * 2 + both[pos_a]
        self._tokens[np.arange(len(ids_b)) + up_to_a[group[pos_b] + 1]] = (self.pair.n_a + ids_b) * 2 + both[pos_b]

    def spelled(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        words = self.pair.spelled[self._tokens].tolist()
        stop = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[x:y])[:-1] for x, y in zip([0, *stop], stop)]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, A id, B id, number of links) of every text's distinct linked pairs."""
        wide_a, wide_b = self.pair.n_a.bit_length(), self.pair.n_b.bit_length()
        keys, times = np.unique((self.doc << (wide_a + wide_b)) | (self.a << wide_b) | self.b, return_counts=True)
        return keys >> (wide_a + wide_b), (keys >> wide_b) & ((1 << wide_a) - 1), keys & ((1 << wide_b) - 1), times


class _Block:
    """Documents of some megabytes of text, as one row."""

    def __init__(self):
        self.bytes, self.rows, self.links, self.n = 0, [], [], 0

    def add(self, doc_ids: list, size: int, cut: Cut, spelled: list[str], keep: bool) -> None:
        doc, a, b, times = cut.distinct()
        sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]
        self.rows.append((doc_ids, cut.n_a.tolist(), cut.n_b.tolist(), cut.n_groups.tolist(), cut.n_links.tolist(), sha, spelled if keep else [None] * cut.n))
        self.links.append((doc + self.n, a, b, times))
        self.n += cut.n
        self.bytes += size

    def closed(self, pair: Pair, number: int, vector: np.ndarray) -> pa.RecordBatch:
        doc, a, b, times = (np.concatenate(x) for x in zip(*self.links))
        same = pair.same[a] == b
        np.add.at(vector, a[same], 1)  # a pair is there once a document
        pairs, at, n = np.unique((a << 32 | b)[~same], return_inverse=True, return_counts=True)
        refs = a.copy()
        refs[~same] = pair.n_a + at
        row = [number, *([x for part in col for x in part] for col in zip(*self.rows)), np.bincount(doc, minlength=self.n).tolist(), refs.astype("<u4").tobytes(), times.astype("<u4").tobytes(), (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), n.tolist(), None]
        return _batch(row)


def _batch(row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(row, _FIELDS)], names=[name for name, _ in _FIELDS])


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """The Python worker's tokenizers."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


class Alignment:
    """Documents encoded by both tokenizers, and the counts of their links.

    ``identity``: documents of each A id's same-bytes pair, as an array;
    ``best``: each A id's highest count; ``pairs()``: all linked pairs with
    their counts; ``documents()``: one row a document.
    """

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False):
        self.spark, self.a_path, self.b_path, self.keep = docs.sparkSession, a_path, b_path, keep_groups
        self.blocks = write_once(self._encoded(docs), "aligned")
        pair = pair_of(a_path, b_path)
        self.n_a, self.same = pair.n_a, pair.same
        self.identity = self._summed()
        rows = self._block_pairs().groupBy("a", "b").agg(F.sum("n").alias("n"))
        self.irregular = write_once(rows, "pairs")
        self.best = self.identity.copy()
        # one row for each A id at most
        for a, n in self.irregular.groupBy("a").agg(F.max("n").alias("n")).collect():
            self.best[a] = max(self.best[a], n)

    def _encoded(self, docs: DataFrame) -> DataFrame:
        a_path, b_path, keep = self.a_path, self.b_path, self.keep

        def run(batches):
            pair, block, number = pair_of(a_path, b_path), _Block(), TaskContext.get().partitionId() << 32
            vector = np.zeros(pair.n_a, np.int64)
            for batch in batches:
                for part in chunks(batch, limit=CHUNK_BYTES):
                    texts = part.column("text").to_pylist()
                    cut = Cut(pair, *pair.encode(texts))
                    block.add(part.column("doc_id").to_pylist(), part.column("text").nbytes, cut, cut.spelled(), keep)
                    if block.bytes >= BLOCK_BYTES:
                        yield block.closed(pair, number, vector)
                        block, number = _Block(), number + 1
            if block.n:
                yield block.closed(pair, number, vector)
            if vector.any():
                yield _batch([None] * (len(_FIELDS) - 1) + [vector.astype("<i8").tobytes()])

        return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)

    def _summed(self) -> np.ndarray:
        """The tasks' vectors added: inside a task first, then slice by slice."""

        def slices(batches):
            total = None
            for batch in batches:
                for v in batch.column("vector"):
                    v = np.frombuffer(v.as_buffer(), "<i8")
                    total = v.copy() if total is None else total + v
            if total is not None:
                parts = [total[x : x + SLICE].tobytes() for x in range(0, len(total), SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part"])

        def add(table):
            total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in table.column("part"))
            return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.tobytes()], pa.binary())})

        schema = "slice int, part binary"
        vectors = self.blocks.select("vector").filter("vector IS NOT NULL").mapInArrow(slices, schema)
        out = np.zeros(self.n_a, np.int64)
        for r in vectors.groupBy("slice").applyInArrow(add, schema).collect():
            part = np.frombuffer(r["part"], "<i8")
            out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
        return out

    def _block_pairs(self) -> DataFrame:
        """(block, at, a, b, n): the irregular pairs of every block and their documents there."""
        rows = self.blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("at", "p"))
        return rows.select("block", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").cast("long").alias("n"))

    def pairs(self) -> DataFrame:
        """(a, b, n, identical): how many documents hold each linked pair."""
        ids = np.flatnonzero(self.identity)
        exact = self.spark.createDataFrame(list(zip(ids.tolist(), self.same[ids].tolist(), self.identity[ids].tolist())), "a int, b int, n long")
        return exact.withColumn("identical", F.lit(True)).union(self.irregular.withColumn("identical", F.lit(False)))

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups])."""
        shared, n_a, keep = self.spark.sparkContext.broadcast((self.identity, self.best)), self.n_a, self.keep
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep

        def scored(key, block, counts):
            identity, best = shared.value
            b = block.to_pylist()[0]
            pair_a = np.array(b["pair_a"], np.int64)
            irregular = np.zeros(len(pair_a), np.int64)
            irregular[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
            refs, times = np.frombuffer(b["refs"], "<u4").astype(np.int64), np.frombuffer(b["times"], "<u4").astype(np.int64)
            n = np.concatenate([identity, irregular])[refs]
            highest = np.concatenate([best, best[pair_a]])[refs]
            stop = np.cumsum(b["n_refs"])
            per_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], stop))])
            b |= {"n_best": per_doc(times * (n == highest)), "count_sum": per_doc(times * n)}
            kinds = [pa.int64()] * 7 + [pa.string()] * (1 + keep)
            return pa.table([pa.array(b[c], k) for c, k in zip(names, kinds)], names=names)

        held = self.blocks.filter("block IS NOT NULL").drop("vector", "pair_b", "pair_n")
        counts = self._block_pairs().select("block", "at", "a", "b").join(self.irregular, ["a", "b"]).select(F.col("block").alias("in_block"), "at", "n")
        schema = ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in names)
        return held.groupBy("block").cogroup(counts.groupBy("in_block")).applyInArrow(scored, schema)


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return Alignment(docs, a_path, b_path).documents()
