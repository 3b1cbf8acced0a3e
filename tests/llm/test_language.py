"""The language model's sample: repeated doc_ids and rare languages."""

import random

from pyspark.sql import types as T

from citegraph.llm import language_crf as lc

SCHEMA = T.StructType([T.StructField(c, k) for c, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.StringType()), ("_h", T.DoubleType()))])


def test_rare_language_is_learned_beside_a_repeated_document(spark, monkeypatch):
    monkeypatch.setattr(lc, "MAX_LABELLED", 120)
    rng = random.Random(3)
    spell = {"aa": "bdgkt", "bb": "lmnrs", "cc": "fvwxz"}
    text = lambda lang: " ".join("".join(rng.choice(spell[lang]) + rng.choice("aeiou") for _ in range(3)) for _ in range(25))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", None, None) for i in range(1500)]
    rows += [(5000 + i, text("cc"), "cc", None, None) for i in range(12)]
    rows += [(7, rows[7][1], "aa", "x", 0.5)] * 900 + [(None, text("bb"), "bb", None, None), (6000, None, "aa", None, None), (6001, "", "aa", None, None), (6002, "12 34", None, None, None), (6003, text("cc") + " " + "word " * 300_000, None, None, None)]
    out = lc.predict(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    rare = [r["lang_pred"] for r in out if r["doc_id"] is not None and 5000 <= r["doc_id"] < 5012]
    assert rare.count("cc") == 12
    held = [(r["doc_id"], r["lang_pred"]) for r in out if r["held_out"] and r["doc_id"] < 1500]
    assert sum(p == ("aa" if i % 2 else "bb") for i, p in held) >= 0.98 * len(held) > 300
    assert {r["lang_pred"] for r in out if r["doc_id"] in (6000, 6001, 6002)} == {"und"}
