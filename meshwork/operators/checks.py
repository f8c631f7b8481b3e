"""Data-quality control: assertions that stop a job, control tables, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """STOP: the data are not what the job expects."""


def _stop(bad: DataFrame, what: str) -> None:
    if rows := bad.limit(3).collect():
        raise CheckFailed(f"STOP: {what}: {[tuple(r) for r in rows]}")


def only_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    _stop(df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).distinct(), f"unexpected {column}")
    return df


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    _stop(df.groupBy(*keys).count().where("count > 1"), f"repeated key {keys}")
    return df


def row_count(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise CheckFailed(f"STOP: {n} rows, expected {expected}")
    return df


def schema_is(df: DataFrame, ddl: str) -> DataFrame:
    want = [x.strip().split(" ", 1) for x in ddl.split(",")]
    have = [[n, t] for n, t in df.dtypes]
    if have != want:
        raise CheckFailed(f"STOP: schema {have}, expected {want}")
    return df


def no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        _stop(df.where(F.col(c).isNull()).select(*columns), f"null {c}")
    return df


def same_values(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: keys on one side only, and the largest difference; stops beyond the tolerance."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    r = j.agg(F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("alone"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("gap"))
    _stop(r.where((F.col("alone") > 0) | (F.col("gap") > tolerance)), f"recomputed {value} differs")
    return r


def control_table(spark: SparkSession, checks: list[tuple[str, float, float, float]]) -> DataFrame:
    """(name, got, expected, tolerance, ok) of checks; stops if one is not ok."""
    df = spark.createDataFrame(checks, "name string, got double, expected double, tolerance double")
    df = df.withColumn("ok", F.coalesce(F.abs(F.col("got") - F.col("expected")) <= F.col("tolerance"), F.lit(False)))
    _stop(df.where("not ok"), "controls")
    return df


def mask_anomalies(df: DataFrame, population: str, shares: list[str], values: list[str], tolerance: float = 0.05) -> DataFrame:
    """Adds ``anomaly`` (no population, or shares that do not sum to one) and nulls ``values`` there."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in shares[1:]), F.coalesce(F.col(shares[0]), F.lit(0.0)))
    df = df.withColumn("anomaly", (F.coalesce(F.col(population), F.lit(0)) == 0) | (F.abs(total - 1) > tolerance))
    return df.withColumns({c: F.when(~F.col("anomaly"), F.col(c)) for c in values})


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of each file, computed by the executors."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def frozen(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    have = {r["file"]: r["sha256"] for r in file_digests(spark, path).collect()}
    if changed := sorted(f for f in expected if have.get(f) != expected[f]):
        raise CheckFailed(f"STOP: frozen inputs changed: {changed}")


def printed_agrees(df: DataFrame, printed: str, value: str) -> DataFrame:
    """Adds ``agrees``: a value lies within half of the last digit of its printed form."""
    digits = F.length(F.regexp_extract(printed, r"[.,](\d+)", 1))
    number = F.regexp_replace(F.col(printed), ",", ".").try_cast("double")
    return df.withColumn("agrees", F.abs(number - F.col(value)) <= 0.5 * F.pow(F.lit(10.0), -digits) + 1e-12)


def settings(given: dict, known: dict) -> dict:
    """Defaults with what is given; stops on unused keys and on other types."""
    if extra := sorted(set(given) - set(known)):
        raise CheckFailed(f"STOP: unused settings {extra}")
    for k, v in given.items():
        if known[k] is not None and not isinstance(v, type(known[k])):
            raise CheckFailed(f"STOP: {k} should be {type(known[k]).__name__}")
    return known | given
