"""Canonical views over the given tables, and the same views as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.functions.scores import hash_number

SPAM_HOST = "spam-farm|cheap-pills|casino-win|free-bets|ads-track"


def hash_split(key: Column) -> Column:
    """64/16/20 train, dev, test by md5 of the key."""
    b = F.pmod(hash_number("split", key, digits=8), F.lit(25))
    return F.when(b < 16, "train").when(b < 20, "dev").otherwise("test")


KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread over the cores when its files give fewer scan tasks than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, KEYS[name]) if name in KEYS else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash `df`, a plain scan, by `key` into one partition per core if the scan has fewer; else leave it alone.

    Text work is bound by the processor, and one large file is one task. A table of many files is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def corpus_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the label is NULL where none is given."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _corpus(docs.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id", "left"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _corpus(docs.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id"))


def _corpus(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        F.col("label").cast("int").alias("label"),
        "source",
        hash_split(F.col("doc_id")).alias("split"),
    )


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages: source is the host, the label marks hosts with a spam name."""
    host = F.regexp_extract("url", r"//([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"),
        "url",
        host.rlike(SPAM_HOST).cast("int").alias("label"),
        host.alias("source"),
        hash_split(F.col("page_id")).alias("split"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with a binary label and a split."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        "embedding",
        (F.col("label") == 0).cast("int").alias("label"),
        hash_split(F.col("vec_id")).alias("split"),
    )


def _split_sql(key: str) -> str:
    b = f"(('0x'||substr(md5('split:'||{key}),1,8))::bigint % 25)"
    return f"CASE WHEN {b}<16 THEN 'train' WHEN {b}<20 THEN 'dev' ELSE 'test' END"


_CORPUS_COLS = (
    "d.doc_id, 'doc://'||d.source||'/'||d.doc_id AS url, d.text, l.toxic AS label, d.source, "
    f"{_split_sql('d.doc_id')} AS split"
)
CORPUS_ALL_SQL = f"corpus_all AS (SELECT {_CORPUS_COLS} FROM documents d LEFT JOIN labels l USING (doc_id))"
CORPUS_SQL = f"corpus AS (SELECT {_CORPUS_COLS} FROM documents d JOIN labels l USING (doc_id))"
WEB_SQL = (
    "web AS (SELECT page_id AS doc_id, url, "
    f"regexp_matches(regexp_extract(url,'//([^/?#]*)',1),'{SPAM_HOST}')::int AS label, "
    "regexp_extract(url,'//([^/?#]*)',1) AS source, "
    f"{_split_sql('page_id')} AS split FROM pages)"
)
VECTORS_SQL = (
    "vectors AS (SELECT vec_id AS doc_id, embedding, (label=0)::int AS label, "
    f"{_split_sql('vec_id')} AS split FROM embeddings)"
)
