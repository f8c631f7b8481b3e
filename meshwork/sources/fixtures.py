"""Panel views over the star-schema tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import table

#: The closed lists of categories of the two panels.
EVENTS = ["click", "error", "purchase", "signup", "view"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def consumption(spark: SparkSession, sf: str) -> DataFrame:
    """(territory_id, period, category, value): supplier by quarter by part type."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    keyed = joined.select(
        (F.col("s_nationkey").cast("long") * 1000 + F.col("l_suppkey")).alias("territory_id"),
        F.date_trunc("quarter", "l_shipdate").cast("date").alias("period"),
        F.col("p_type").alias("category"),
        "l_extendedprice",
    )
    return keyed.groupBy("territory_id", "period", "category").agg(F.sum("l_extendedprice").alias("value"))


def consumption_users(spark: SparkSession, sf: str) -> DataFrame:
    """(territory_id, period, category, value): user by week by event type."""
    events = table(spark, sf, "events")
    return events.groupBy(F.col("user_id").cast("long").alias("territory_id"), F.date_trunc("week", "ts").cast("date").alias("period"), F.col("event_type").alias("category")).agg(F.sum("value").alias("value"))


def territory(spark: SparkSession, sf: str) -> DataFrame:
    """Node attributes: name, type, region, district and a positive access index."""
    customer = table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.col("c_custkey").cast("long").alias("territory_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("district_type"),
        F.col("c_nationkey").cast("long").alias("region_code"),
        F.col("n_name").alias("region_name"),
        F.col("r_name").alias("federal_district"),
        (F.col("c_acctbal") + 1000.0).alias("market_access"),
    )


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Several versions per id."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("long").alias("territory_id"),
        F.col("o_orderkey").cast("long").alias("version_key"),
        F.year("o_orderdate").cast("long").alias("year_from"),
        F.col("o_orderpriority").alias("district_type"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, x, label): all vectors, as doubles, with their label."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))


def stored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, x, label) with vectors as they are stored; operators by blocks widen them in the task, so that half as much is moved."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x"), F.col("label").cast("long").alias("label"))


VIEWS = {
    "fx_consumption": """SELECT CAST(s_nationkey AS BIGINT) * 1000 + l_suppkey AS territory_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period,
        p_type AS category, SUM(l_extendedprice) AS value
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""",
    "fx_users": """SELECT CAST(user_id AS BIGINT) AS territory_id, CAST(date_trunc('week', ts) AS DATE) AS period, event_type AS category, SUM(value) AS value
        FROM events GROUP BY 1, 2, 3""",
    "fx_territory": """SELECT CAST(c_custkey AS BIGINT) AS territory_id, c_name AS name, c_mktsegment AS district_type, CAST(c_nationkey AS BIGINT) AS region_code,
        n_name AS region_name, r_name AS federal_district, c_acctbal + 1000.0 AS market_access
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "fx_dictionary": """SELECT CAST(o_custkey AS BIGINT) AS territory_id, CAST(o_orderkey AS BIGINT) AS version_key,
        CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS year_from, o_orderpriority AS district_type FROM orders""",
    "fx_nodes": "SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS BIGINT) AS label FROM embeddings",
}


def with_views(*names: str, more: str = "") -> str:
    """A WITH clause that defines the named views; ``more`` continues it."""
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return "WITH RECURSIVE " + head + (",\n" + more if more else "") + "\n"
