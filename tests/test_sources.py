"""Scans of awkward files."""

import pytest

from citegraph.sources import files as IO

CELLS = ['plain', 'a "quoted" word', 'comma, and "both", here', 'two\nlines', 'quote " at\n"line" breaks, and comma', '"', '""', "", "é ü ñ", "back\\slash \\" + '"']


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
@pytest.mark.parametrize("lines", [True, False])
def test_csv_cells_come_back(spark, tmp_path, encoding, lines):
    """Quotes, commas and line breaks inside cells, in both encodings."""
    rows = [(i, c, "x") for i, c in enumerate(CELLS) if lines or "\n" not in c]
    path = str(tmp_path / "cells")
    writer = spark.createDataFrame(rows, "id int, text string, last string").coalesce(2).write.option("header", True).option("encoding", encoding)
    writer.option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = IO.scan_csv_encoding_fallback(spark, f"{path}/*.csv", "id int, text string, last string").collect()
    assert sorted((r["id"], r["text"] or "", r["last"]) for r in got) == rows


def test_tolerant_scan_reads_once_and_keeps_nothing_cached(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "part.json").write_text('{"a": 1}\n{"a": oops\n{"a": 2}\n')
    good, bad = IO.scan_tolerant(spark, f"{tmp_path}/*.json", T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    assert not good.storageLevel.useMemory
