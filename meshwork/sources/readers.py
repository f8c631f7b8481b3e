"""Readers for what Spark has no format for, and thin wrappers for what it has.

Archives and databases are read with ``binaryFile``, one row per file, and unpacked in
Arrow tasks, so that any store that Spark reads will do. Each file must fit a task.
"""

from __future__ import annotations

import csv
import io
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_strings(spark: SparkSession, path: str, columns: list[str], sep: str = ",", strict: bool = True) -> DataFrame:
    """A CSV with header whose fields all stay strings; an empty field is "" and not null.

    ``strict`` fails on rows with another number of fields.
    """
    df = spark.read.schema(strings(columns)).option("header", True).option("sep", sep).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def zip_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", member: str = r"\.csv$", keep: Callable[[pd.DataFrame], pd.Series] | None = None, chunk: int = 100_000) -> DataFrame:
    """Rows of the CSV members of ZIP archives, read in chunks, with only these columns and all as strings; ``keep`` filters a chunk."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if re.search(member, name):
                            for part in pd.read_csv(z.open(name), sep=sep, usecols=columns, dtype=str, keep_default_na=False, chunksize=chunk, quoting=csv.QUOTE_MINIMAL):
                                yield (part if keep is None else part[keep(part)])[columns]

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, strings(columns))


def xlsx_rows(content: bytes, sheet: int = 0) -> list[list[str]]:
    """Cells of a sheet as strings, by position; shared and inline strings, numbers as they are written."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        rows = []
        for row in ET.fromstring(z.read(names[sheet])).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", ns):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r", "A1"))[0]:
                    at = at * 26 + ord(letter) - 64
                v = c.find("m:v", ns)
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif v is not None and v.text is not None:
                    cells[at - 1] = shared[int(v.text)] if kind == "s" else v.text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def xlsx(spark: SparkSession, path: str, columns: list[str], sheet: int = 0) -> DataFrame:
    """Rows under the header of a workbook's sheet, these columns as strings."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                head, *rows = xlsx_rows(content, sheet)
                at = [head.index(c) for c in columns]
                yield pd.DataFrame([[r[i] if i < len(r) else "" for i in at] for r in rows], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, strings(columns))


def strip_gpkg(blob: bytes) -> bytes:
    """The WKB of a GeoPackage geometry: behind an 8-byte header and an envelope of a size that its flags give."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :]


def geopackage(spark: SparkSession, path: str, sql: str, schema: str, geometry: str | None = None) -> DataFrame:
    """Rows of a query on SQLite databases; ``geometry`` names a column of which the header is stripped."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                out = pd.DataFrame(db.execute(sql).fetchall(), columns=names)
                db.close()
                if geometry:
                    out[geometry] = out[geometry].map(strip_gpkg)
                yield out

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: array<array<array<array<double>>>>>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature line of a GeoJSON with MultiPolygons: (properties, coordinates)."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("v")).where("v like '{\"type\":\"Feature\"%'")
    return lines.select(F.from_json("v", FEATURE).alias("f")).select("f.properties", F.col("f.geometry.coordinates").alias("coordinates"))


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several paths that exists, by its ending: parquet, csv, json or orc."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            kind = p.rsplit(".", 1)[-1]
            return spark.read.option("header", True).format(kind if kind in ("csv", "json", "orc") else "parquet").load(p)
    raise FileNotFoundError(f"none of {paths}")
