"""Token counts kept between runs, by the content of the text and the name of the tokenizer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.operators.relational import join_groups
from crivo.session import publish

SCHEMA = "hash string, n bigint"


class TokenCounts:
    """Counts (SHA-256 of the text, n) under a folder that the cluster shares, one part for each run that found new texts.

    Keyed by content, a count never goes stale: a changed text is a new one, and rows may come and go.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{tokenizer}"

    def known(self) -> DataFrame:
        """(hash, n) of all texts counted so far; two runs side by side may have counted a text twice, to the same number."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        parts = [s.getPath().toString() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        parts = [p for p in parts if not p.endswith("/_work")]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("hash").agg(F.max("n").alias("n"))

    def update(self, df: DataFrame, counter: Callable[[Column], Column]) -> int:
        """Count the texts of `df` (text) that are not known yet, each once however many rows have it; how many there were."""
        texts = df.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
        new = texts.join(self.known(), "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))
        work = f"{self.path}/_work/{uuid.uuid4().hex}"
        new.select("hash", counter(F.col("text")).cast("bigint").alias("n")).write.parquet(work)
        found = self.spark.read.schema(SCHEMA).parquet(work).count()
        if found:
            publish(self.spark, work, f"{self.path}/{uuid.uuid4().hex}")
        return found

    def counts(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, tokens) of the rows of `df` (key, text), whose texts are known; one text may be that of most rows."""
        rows = df.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
        sizes = rows.groupBy("hash").agg(F.count("*").alias("_rows")).join(self.known(), "hash")
        return join_groups(rows, sizes, "hash", "_rows", key).select(key, F.col("n").alias("tokens"))
