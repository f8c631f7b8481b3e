"""Numbers in texts traced to the values of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A number of ASCII digits with a sign or without, and the most digits that it may have to be traced.
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
MOST = 15


def numbers(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, digits, units, n): a text's numbers as whole units of their last digit, with how often they occur; units are null beyond 15 digits."""
    found = texts.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(0))).alias("t"))
    digits = F.when(F.instr("t", ".") > 0, F.length("t") - F.instr("t", ".")).otherwise(0)
    bare = F.translate("t", ".", "")
    units = F.when(F.length(F.translate("t", ".-", "")) <= MOST, bare.try_cast("long"))
    return found.select("id", digits.cast("int").alias("digits"), units.alias("units")).groupBy("id", "digits", "units").agg(F.count(F.lit(1)).alias("n"))


def traced(texts: DataFrame, id: str, text: str, values: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """(id, n_numbers, n_traced): how many of a text's numbers lie within half of their last digit of some value.

    This is a join of tolerance by equality: a value has two keys for each count of digits up to ``digits``, the whole units below and above it, and the one within half a unit
    is kept (both at a tie). Numbers with more digits are not traced. Texts without numbers give no row. Numbers are counted by text and values are made distinct before they meet.
    """
    n = numbers(texts, id, text)
    scaled = values.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()).distinct().select("v", F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("digits"))
    scaled = scaled.withColumn("s", F.col("v") * F.pow(F.lit(10.0), F.col("digits"))).where(F.abs("s") < 10.0**MOST)
    near = scaled.select("digits", "s", F.explode(F.array(F.floor("s"), F.floor("s") + 1)).alias("units")).where(F.abs(F.col("s") - F.col("units")) <= 0.5 + 1e-6)
    known = near.select("digits", "units").distinct().withColumn("known", F.lit(True))
    met = n.join(known, ["digits", "units"], "left")
    return met.groupBy("id").agg(F.sum("n").alias("n_numbers"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("n_traced"))
