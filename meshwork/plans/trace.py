"""Numbers of names and texts traced to table values."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.operators import trace
from meshwork.plans.base import query
from meshwork.session import table

SQL = r"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?')) AS t FROM documents),
n AS (SELECT id, CASE WHEN strpos(t, '.') > 0 THEN length(t) - strpos(t, '.') ELSE 0 END AS digits, CASE WHEN length(replace(replace(t, '.', ''), '-', '')) <= 15 THEN TRY_CAST(replace(t, '.', '') AS BIGINT) END AS units FROM t),
v AS (SELECT DISTINCT CAST(p_retailprice AS DOUBLE) AS v FROM part WHERE p_retailprice IS NOT NULL),
s AS (SELECT range AS digits, v * pow(10.0, range) AS s FROM v, range(0, 5)),
k AS (SELECT DISTINCT digits, CAST(floor(s) AS BIGINT) + o.range AS units FROM s, range(0, 2) o WHERE abs(s) < 1e15 AND abs(s - (floor(s) + o.range)) <= 0.5 + 1e-6)
SELECT id, count(*) AS n_numbers, count(k.units) AS n_traced FROM n LEFT JOIN k USING (digits, units) GROUP BY 1"""


@query(SQL)
def traced_numbers(spark, sf):
    """How many numbers of each document are a part's price, to the last digit that the document gives."""
    return trace.traced(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "part"), "p_retailprice").withColumn("n_traced", F.col("n_traced").cast("long"))
