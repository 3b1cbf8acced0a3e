import re

from pyspark.sql import functions as F

from citegraph.functions import columns as C
from citegraph.operators import text as X
from citegraph.plans import standins as S
from conftest import SF01

SAMPLES = ["hello world", "they're here", "1st place (draft)", "ÉCOLE normale", 'x"y', "already_Title", "mIxEd CaSe"]


def test_sanitise_title_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s STRING")
    got = [r.t for r in df.select(C.sanitise_name("s", "title").alias("t")).collect()]
    exp = [re.sub(r"""[\s'"()]""", "_", s).title() for s in SAMPLES]
    assert got == exp


def test_sanitise_file_name(spark):
    df = spark.createDataFrame([('a<b>c:d"e/f\\g|h?i*j',)], "s STRING")
    assert df.select(C.sanitise_name("s", "file").alias("t")).first().t == "a_b_c_d_e_f_g_h_i_j"


def test_language_scores_agree_with_labels(spark):
    docs = S.table(spark, SF01, "documents").select("doc_id", "text", "lang")
    r = X.language_scores(docs, "text").agg(
        F.avg((F.col("detected_lang") == F.col("lang")).cast("double")).alias("acc"),
        F.avg(F.col("detected_lang").isNull().cast("double")).alias("undetected"),
    ).first()
    assert r.acc > 0.98 and r.undetected < 0.05


def test_token_counts_python_semantics(spark):
    df = spark.createDataFrame([("a, b, a",), ("",), (None,)], "s STRING")
    rows = df.select(C.token_count("s").alias("n"), C.token_distinct_count("s").alias("d")).collect()
    # len(x.split(',')) and len(set(x.split(','))); NULL -> 0
    assert [(r.n, r.d) for r in rows] == [(3, 3), (1, 1), (0, 0)]
