"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import graphml, graphml_ends


def by_month(df: DataFrame, path: str, month: str = "month") -> None:
    """A directory per month; months that are written again are replaced, others stay."""
    df.repartition(month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def feature_lines(df: DataFrame, properties: list[str], digits: int) -> DataFrame:
    """A GeoJSON feature per row from ``coordinates``, rounded, without a point that repeats the one before it."""
    point = lambda p: F.transform(p, lambda v: F.round(v, digits))

    def ring(r):
        rounded = F.transform(r, point)
        return F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))

    coords = F.transform("coordinates", lambda poly: F.transform(poly, ring))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The body as text parts in order; a head and a foot around them make one document."""
    head, foot = graphml_ends()
    spark = nodes.sparkSession
    end = lambda text, at: spark.createDataFrame([(at, text)], "at int, value string")
    body = graphml(nodes, edges).withColumn("at", F.lit(1))
    end(head, 0).unionByName(body.select("at", "value")).unionByName(end(foot, 2)).coalesce(1).sortWithinPartitions("at", F.desc(F.col("value").startswith("<node"))).select("value").write.mode("overwrite").text(path)


def packed_payload(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """(group, payload): the ordered integers of a group as first value and differences, as JSON in base64."""
    v = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])
    out = df.groupBy(*group).agg(v.alias("_v"))
    delta = F.transform("_v", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("_v", i - 1)))
    return out.select(*group, F.base64(F.encode(F.to_json(delta), "UTF-8")).alias("payload"))


def markdown_lines(df: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """(at, key, value): a Markdown table's lines, to be ordered by at and key; doubles are rounded, nulls are empty, bars and line ends are masked."""

    def cell(name: str, kind: str):
        c = F.round(name, digits) if kind in ("double", "float") else F.col(name)
        return F.coalesce(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\|", r"\\|"), r"[\r\n]+", " "), F.lit(""))

    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "at int, value string")
    body = df.select(F.lit(2).alias("at"), F.struct(*order).alias("key"), row([cell(n, k) for n, k in df.dtypes]).alias("value"))
    return head.unionByName(body, allowMissingColumns=True)


def write_markdown(df: DataFrame, path: str, order: list[str], most: int = 10_000, digits: int = 4) -> None:
    """A report's table as one text file; a table of more than ``most`` rows is refused, since it isn't a report."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write it as a table instead")
    markdown_lines(df, order, digits).coalesce(1).sortWithinPartitions("at", "key").select("value").write.mode("overwrite").text(path)


def write_scalar(df: DataFrame, path: str) -> None:
    """The one value of a frame of one row and one column, as a text file."""
    if len(df.columns) != 1 or df.limit(2).count() != 1:
        raise ValueError("a frame of one row and one column is needed")
    df.select(F.col(df.columns[0]).cast("string")).coalesce(1).write.mode("overwrite").text(path)
