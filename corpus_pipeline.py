"""A training corpus in five stages: quality rules, exact dedup, near-dedup, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import exact_dedup, packing, quality_rules, simhash, source_mixing
from meshwork.session import materialize, table

#: SQL for ``run``: none, since DuckDB's SQL has no XXH64 and no BPE tokenizer. Tests hold it against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document and host rules."""
    return quality_rules.keep_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return simhash.keep_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule mixes their sources."""
    return source_mixing.in_mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; documents are ranked by their place in the files that the last stage wrote."""
    import public_tokenizers

    if docs.inputFiles():
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d{1,9})", 1).try_cast("long")
        place = F.coalesce(part, F.lit(0)) * (1 << 36) + F.col("_metadata.row_index")
        docs = docs.withColumn("_place", place)
    order = "_place" if "_place" in docs.columns else None
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), order=order)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each reads the parquet that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
