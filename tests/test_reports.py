"""Text sinks: tables of a report and single values."""

import glob

import pytest

from meshwork.sources import writers


def text_of(path):
    return "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{path}/part-*"))


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.123456, "a|b"), (1, None, "two\nlines"), (3, 2.0, None)], "k int, x double, s string").repartition(3)
    writers.write_markdown(df, f"{tmp_path}/t", ["k"])
    assert text_of(f"{tmp_path}/t") == "| k | x | s |\n|---|---|---|\n| 1 |  | two lines |\n| 2 | 0.1235 | a\\|b |\n| 3 | 2.0 |  |\n"
    with pytest.raises(ValueError, match="more than 2 rows"):
        writers.write_markdown(df, f"{tmp_path}/u", ["k"], most=2)


def test_scalar(spark, tmp_path):
    writers.write_scalar(spark.sql("SELECT sha2('x', 256) AS s"), f"{tmp_path}/s")
    assert len(text_of(f"{tmp_path}/s").strip()) == 64
    with pytest.raises(ValueError, match="one row"):
        writers.write_scalar(spark.range(2), f"{tmp_path}/r")
