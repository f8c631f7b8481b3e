"""Relational shaping: shares, pivots, versions, key resolution, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio


def shares(fact: DataFrame, keys: list[str], category: str = "category", value: str = "value") -> DataFrame:
    """Adds total and share of each category in its key."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return fact.withColumn("total", total).withColumn("share", ratio(F.col(value), F.col("total")))


def wide(fact: DataFrame, keys: list[str], categories: list[str], value: str, category: str = "category", fill: float | None = None) -> DataFrame:
    """One column per category, in the order given; a single aggregation, since the categories are known."""
    out = fact.groupBy(*keys).pivot(category, categories).agg(F.sum(value))
    return out if fill is None else out.fillna(fill, subset=categories)


def join_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join whose right side has at most one row per key; the query fails where it has more."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    checked = right.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("the right side of an N:1 join repeats a key")))
    return left.join(checked.where(F.col("_ok").isNull()).drop("_n", "_ok"), on, how)


def full_outer_status(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys of either side with ``status`` both, left or right."""
    x, y = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return x.join(y, on, "full_outer").select(*on, status.alias("status"))


def latest_version(versions: DataFrame, key: str, year: str) -> DataFrame:
    """All rows at the latest year of their key."""
    return versions.withColumn("_last", F.max(year).over(Window.partitionBy(key))).where(F.col(year) == F.col("_last")).drop("_last")


def resolve(rows: DataFrame, key: list[str], priority: Column, order: list[Column]) -> DataFrame:
    """One row per key: the best by priority, then by ``order``; adds how many tied on priority."""
    p = rows.withColumn("_p", priority)
    by = Window.partitionBy(*key)
    p = p.withColumn("_best", F.min("_p").over(by)).where(F.col("_p") == F.col("_best"))
    p = p.withColumn("n_tied", F.count(F.lit(1)).over(by)).withColumn("_r", F.row_number().over(by.orderBy(*order)))
    return p.where("_r = 1").drop("_p", "_best", "_r")


def densify(rows: DataFrame, ids: DataFrame, periods: DataFrame) -> DataFrame:
    """Every id with every period, joined with the rows; the period list is a short dimension."""
    return ids.join(F.broadcast(periods)).join(rows, [*ids.columns, *periods.columns], "left")


def completeness(fact: DataFrame, keys: list[str], categories: list[str], category: str = "category") -> DataFrame:
    """Keys that lack categories, with the number they have and the names of those missing."""
    have = fact.groupBy(*keys).agg(F.collect_set(category).alias("_have"), F.count(F.lit(1)).alias("n_rows"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, categories)), F.col("_have")))
    return have.withColumn("missing", F.array_join(missing, ",")).withColumn("n_missing", F.size(missing)).where("n_missing > 0").drop("_have")


def full_history(fact: DataFrame, key: str, period: str, least: int) -> DataFrame:
    return fact.groupBy(key).agg(F.countDistinct(period).alias("n_periods")).where(F.col("n_periods") >= least)


def top_text(rows: DataFrame, group: list[str], name: str, n: str, k: int) -> DataFrame:
    """"name n; name n" of the k largest per group, ties by name."""
    items = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("m"), F.col(name).alias("name"))))
    text = F.array_join(F.transform(F.slice(items, 1, k), lambda x: F.concat_ws(" ", x["name"], (-x["m"]).cast("string"))), "; ")
    return rows.groupBy(*group).agg(text.alias("text"))


def set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the sets of rows of two frames with the same columns."""
    status = full_outer_status(a, b, a.columns)
    return status.agg(
        F.count_if(F.col("status") != "right").alias("n_a"),
        F.count_if(F.col("status") != "left").alias("n_b"),
        F.count_if(F.col("status") == "both").alias("n_both"),
        F.count(F.lit(1)).alias("n_either"),
    )


def min_count_sum(x: Column, least: int) -> Column:
    """The sum, or null if fewer than ``least`` values are there."""
    return F.when(F.count(x) >= least, F.sum(x))
