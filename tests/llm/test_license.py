"""Licence scan: base phrases by regular expressions, notices planted in prose."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from citegraph.llm import license_scan as ls

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n_words", T.DoubleType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILL = [f"fill{i}" for i in range(200)] + ["the", "of", "and", "this", "is", "to", "by", "a"] * 6


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def prose(rng, n):
    return " ".join(rng.choice(FILL) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """(text, label that must be found or None)."""
    rng = random.Random(2)
    out = []
    for label, text, _ in ls.TEMPLATES:
        out.append((f"{prose(rng, 50)}. {text}. {prose(rng, 40)}", label))
        marked = "\n".join(f" * {line}" for line in re.sub(r"(.{60}\S*) ", r"\1\n", text).split("\n"))
        out.append((f"/*\n{marked}\n */ {prose(rng, 80)}", label))
    return out


@pytest.fixture(scope="module")
def rows(planted):
    rng = random.Random(4)
    out = [None, "", " ", "12 ... !!", "CC", "cc by", "cc by nc", "CC-BY-NC 4.0 cc by-nc", "under the MIT\nlicense under the mit license", "under the mit licenses", "Under The MIT, License é", "apache license version 2.0", "apache license version 20", "apache license, version 2 apache license version 2",
           "under the under the mit license", "cc by nc " * 500, prose(rng, 30_000) + " under the mit license", "ünder the mit license", "nc by cc by nc by nc"]
    out += [t for t, _ in planted] + [prose(rng, rng.randrange(1, 300)) for _ in range(40)]
    docs = [(i, t, "x", None, 1.0) for i, t in enumerate(out)]
    return docs + [(None, "null id under the mit license", None, None, None), docs[8], docs[8], (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_base_places(docs, rows):
    phrases = [(label, words(text)) for label, text in ls.BASE]

    def one(r):
        w = words(r[1])
        at = sorted((i, label) for label, p in phrases for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
        return (r[0], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at})))

    got = [tuple(r) for r in ls.digest(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    assert sorted(got, key=repr) == sorted((one(r) for r in rows), key=repr)
    assert sum(r[2] for r in got) > 500


def test_notices(docs, rows, planted):
    got = {r["doc_id"]: r for r in ls.scan(docs).collect() if r["doc_id"] is not None}
    label_of = dict(planted)
    for r in rows:
        if r[0] is None:
            continue
        found = got[r[0]]
        labels = set(found["labels"].split(",")) - {""}
        assert set(found["base_labels"].split(",")) - {""} <= labels
        assert labels == set(found["match_labels"]) and (found["score"] > 0) == bool(labels)
        assert 0 <= found["score"] <= 1 and all(0 <= s < max(1, found["n_words"]) for s in found["match_starts"])
        if r[1] in label_of:
            assert label_of[r[1]] in labels, (label_of[r[1]], labels)
            assert found["score"] > 0.99
        elif not found["base_labels"]:
            assert not labels or r[0] < 19, r[1][:80]


def test_changed_notices(spark):
    rng = random.Random(9)
    label, text, keys = ls.TEMPLATES[0]
    inserted = text.replace("to any person", "to any other natural person").replace("copies of the Software", "")
    no_key = text.replace("to deal in the Software", "to look at the Software")
    far = text.replace("to deal in the Software", prose(rng, 60) + " to deal in the Software")
    back = " ".join(reversed(text.split()))
    rest = [(i + 10, prose(rng, 100), None, None, None) for i in range(50)]
    rows = [(i, prose(rng, 20) + " " + t, None, None, None) for i, t in enumerate([inserted, no_key, far, back, " ".join(text.split()[:20])])]
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(rows + rest, SCHEMA)).collect()}
    assert "mit" in got[0]["labels"] and ls.SHARE <= got[0]["score"] < 1
    assert all(got[k]["labels"] == "" and got[k]["score"] == 0 for k in (1, 2, 3, 4))


def test_document_frequencies(docs, rows):
    held, n = ls.document_frequencies(docs)
    sets = [set(words(r[1])) for r in rows]
    assert n == len(rows)
    assert held.tolist() == [sum(w in s for s in sets) for w in ls.index().vocabulary]
    assert (np.diff(ls.weights(docs)[np.argsort(held)]) <= 0).all()


def test_long_text_and_empty_table(spark):
    text = "copying " * 400_000 + "under the MIT license"
    (r,) = ls.digest(spark.createDataFrame([(5, text, None, None, None)], SCHEMA)).collect()
    assert (r["n_words"], r["n_base"], r["first_word"], r["base_labels"]) == (400_004, 1, 400_000, "mit")
    empty = spark.createDataFrame([], SCHEMA)
    assert ls.digest(empty).count() == 0 and ls.document_frequencies(empty)[1] == 0
