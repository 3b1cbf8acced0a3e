"""Cross-tokenizer alignment against a token-by-token walk."""

import hashlib
import json
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import types as T

from citegraph.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType()), T.StructField("a", T.DoubleType()), T.StructField("vector", T.StringType())])
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

TEXTS = [
    None, "", " ", "  \n\t ", "word", "aaaaaaaaaaa aaa", "na na na " * 500, "Hello, world! It's 12345 o'clock.", "Hello, world! It's 12345 o'clock.",
    "<|endoftext|> and <s> </s> <unk> <0x41> stay text", "▁ is B's space", "naïve café   　x 中文字符 😀 ꙮ \u0000 \u0085 é", "ﬁ ligature ½ ² Ａ", "def f(x):\n    return x  # ☃\r\n\r\n", "x" * 3000, "the quick brown fox " * 4000, "1.5e-10 == 0x1F; a_b-c/d",
]


def walk(texts):
    """Rows and pair counts, one token at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    spell = {i: t for t, i in tok.get_vocab().items()}
    alphabet = ta._byte_alphabet()
    done, counts = [], Counter()
    for t in texts:
        a, b, groups, links = [], [], [], []
        if t:
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            bytes_a = [bytes(alphabet[c] for c in spell[i]) for i in a]
            bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                a, b = [], []
        if a:
            i = j = stop_a = stop_b = 0
            at = [0, 0]
            while i < len(a):
                links.append((a[i], b[j]))
                stop_a, stop_b = at[0] + len(bytes_a[i]), at[1] + len(bytes_b[j])
                if stop_a <= stop_b:
                    at[0], i = stop_a, i + 1
                if stop_b <= stop_a:
                    at[1], j = stop_b, j + 1
                if stop_a == stop_b:
                    g = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups)
                    groups.append((a[g[0] : i], b[g[1] : j]))
        done.append((len(a), len(b), groups, links))
        counts.update(set(links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for na, nb, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((na, nb, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if na else ""))
    return rows, counts


@pytest.fixture(scope="module")
def rows(spark):
    prose = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    short = [t[:1500] if t else t for t in TEXTS]  # the walk sums its groups again and again
    return [(i, t, "x", 0.5, None) for i, t in enumerate(short + [t and t[:2000] for t in prose])] + [(None, "a null id", None, None, None), (None, None, "", None, None), (7, TEXTS[7], "b", 1.0, "v")]


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_documents_and_pairs(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ta, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(ta, "BLOCK_BYTES", block)
    want, counts = walk([r[1] for r in rows])
    aligned = ta.Alignment(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    got = [tuple(r) for r in aligned.documents().select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert any(w[0] == 0 for w, r in zip(want, rows) if r[1]), "a text whose bytes differ"
    pairs = {(r["a"], r["b"]): (r["n"], r["identical"]) for r in aligned.pairs().collect()}
    assert {p: n for p, (n, _) in pairs.items()} == dict(counts)
    bytes_of = ta.pair_of(A, B)
    assert all(same == (bytes_of.a.bytes[a] == bytes_of.b.bytes[b]) for (a, b), (_, same) in pairs.items())
    assert sum(same for _, same in pairs.values()) > 100


def test_groups_of_long_texts(spark):
    """Whole texts longer than a chunk; the spelled groups hold all ids in order."""
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS + ["lorem ipsum, dolor 42! " * 80_000])]
    out = ta.Alignment(spark.createDataFrame(rows, SCHEMA), A, B, keep_groups=True).documents().collect()
    pair = ta.pair_of(A, B)
    for r in out:
        a, b = (x[0] for x in pair.encode([rows[r["doc_id"]][1]]))
        sides = [g.split("|") for g in r["groups"].split(";")] if r["groups"] else []
        assert [int(x) for g in sides for x in g[0].split(",")] == a and [int(x) for g in sides for x in g[1].split(",")] == b
        assert r["n_groups"] == len(sides) and r["n_links"] == len(a) + len(b) - len(sides)
        assert all(b"".join(pair.a.bytes[int(x)] for x in g[0].split(",")) == b"".join(pair.b.bytes[int(x)] for x in g[1].split(",")) for g in sides[:2000])


def test_empty_table(spark):
    aligned = ta.Alignment(spark.createDataFrame([], SCHEMA), A, B)
    assert aligned.documents().count() == 0 and aligned.pairs().count() == 0


def test_fast_encoder_equals_the_file():
    """Every code point, beside letters, digits, signs and spaces, as the tokenizer file encodes it."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    fast = ta.ByteLevel(A)
    assert fast._many is None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 17 == 0)]
    for k in range(0, len(points), 4000):
        texts = [f" a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}  {chr(c)}" for c in points[k : k + 4000]]
        assert fast.encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_other_byte_level_files(tmp_path):
    """A file whose ids do not follow its merges goes through its own library."""
    alphabet = list(ta._byte_alphabet())
    vocab = {c: i for i, c in enumerate(alphabet)} | {"ab": 300, "abc": 256}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None,
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": ["a b", "ab c"]}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    t = ta.ByteLevel(str(path))
    assert t._many is not None
    assert [b"".join(t.bytes[i] for i in ids) for ids in t.encode(["abcab x", " é"])] == [b"abcab x", " é".encode()]
