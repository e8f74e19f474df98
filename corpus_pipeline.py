"""From raw documents to packed training sequences: quality, exact and near duplicates, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written before the next stage reads it. All but the
last return documents with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crivo.llm import exactdedup, mixing, neardup, packing, quality
from crivo.llm.queries import tokenizer_file
from crivo.plans.registry import query
from crivo.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality(docs).where("kept").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts."""
    return exactdedup.keep(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Rows that repeat a doc_id go only if none of them stays."""
    verdicts = neardup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = verdicts.where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule: the mixture, then what is over a source's share."""
    mixed = mixing.mix(docs, excess=True)
    ordered = mixed.repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and their places in training sequences."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The match and mixing stages cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of each is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


query("pipeline", ORACLE_SQL)(run)
