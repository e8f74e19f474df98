"""Exact deduplication by a stream whose state never expires.

The stream reads one narrow record per document: digest, stable identifier, length and content locator (where the
full text lies). Its state, kept on disk by RocksDB under the query's checkpoint, holds for every digest the record
that stays and the number of records seen. Later batches fold into the same state, so a table that grows is
deduplicated by streaming only its new files. The state itself is then read as a table.

A digest that was hit more than once is checked on full bytes: the text at the locator in the state is compared with
every other text of that digest. Texts that differ under one digest are grouped by their full bytes instead.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.llm.prefilter import drop_absent
from crivo.operators.relational import join_groups
from crivo.session import materialise, scratch

SPACE = "[\\x20\\x09-\\x0D]+"
#: The state store, and its memory for all of an executor's partitions together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # no disk set aside ahead of use: there may be many small partitions
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column | str) -> Column:
    """The text without white space; a null text is empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fold_stream(records: DataFrame, state: str) -> None:
    """Fold a streaming table of records (digest, doc_id, points, locator) into the state under the path `state`.

    Runs until all files now there are read. Called again with the same path, it reads only files that came since.
    """
    stay = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "locator")
    seen = records.groupBy("digest").agg(F.min(stay).alias("stay"), F.count("*").alias("group_size"))
    with _settings(records.sparkSession, STATE):
        run = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
        run.trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """(digest, stay, group_size): what the state holds now."""
    with _settings(spark, STATE):
        held = spark.read.format("statestore").load(state)
        names = held.schema["value"].dataType.names
        value = [F.col(f"value.`{n}`") for n in names]
        return held.select(F.col("key.digest").alias("digest"), value[-2].alias("stay"), value[-1].alias("group_size"))


def located(docs: DataFrame) -> DataFrame:
    """`row`, a struct of all columns, and `locator`, file and row. A table that is no plain scan is written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")
    try:
        return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), place)
    except AnalysisException:
        return located(materialise(docs, "dedup-documents"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Group the rows of `docs` (doc_id, text) whose texts are equal once white space is deleted.

    One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, lower-case hex) and
    locator (file, row). The row with the most code points in its original text stays, then the smallest doc_id, null
    last, then the first locator: of rows that repeat a doc_id one is kept. Null, empty and blank texts are equal to each
    other. Other columns are ignored. An empty table gives no rows.
    """
    return _deduplicate(located(docs), digest)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    at = located(docs)
    gone = _deduplicate(at, sha256).where("NOT kept").select("locator")
    return at.join(gone, "locator", "left_anti").select("row.*")


def _deduplicate(at: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    spark = at.sparkSession
    source = at.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "locator")
    text = normalised("text")
    records = source.select("doc_id", F.length("text").alias("points"), "locator", sha256(text).alias("sha256"), digest(text).alias("digest"))
    path = scratch(spark, "dedup-records")
    records.select("doc_id", F.coalesce("points", F.lit(0)).alias("points"), "locator", "sha256", "digest").write.parquet(path)
    landed = spark.read.schema(records.schema).parquet(path)

    state = scratch(spark, "dedup-state")
    fold_stream(spark.readStream.schema(records.schema).parquet(path), state)
    with _settings(spark, STATE):  # the state's memory limit must hold while it is read
        held = materialise(read_state(spark, state), "dedup-groups")

    hit = held.where("group_size > 1")
    suspects = landed.join(hit.select("digest", "stay"), "digest")
    suspects = suspects.select("digest", "locator", (F.col("locator") == F.col("stay.locator")).alias("stays"))
    bodies = drop_absent(source, suspects, "locator").join(suspects, "locator").select("digest", "locator", "stays", "doc_id", F.length("text").alias("points"), text.alias("body"))
    bodies = materialise(bodies, "dedup-bodies")
    first = bodies.where("stays").select("digest", F.col("body").alias("first_body")).join(hit.select("digest", "group_size"), "digest")
    compared = join_groups(bodies.where("NOT stays").select("digest", "body", "locator"), first, "digest", "group_size", "locator")
    differing = compared.where("body <> first_body").select("digest").distinct()
    differing = materialise(differing, "dedup-differing")

    out = landed.join(held, "digest").select("doc_id", "locator", "sha256", "stay", "group_size")
    if not differing.isEmpty():
        stay = F.struct((-F.coalesce("points", F.lit(0))).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "locator")
        apart = bodies.join(differing, "digest")
        exact = apart.groupBy("digest", "body").agg(F.min(stay).alias("exact_stay"), F.count("*").alias("exact_size"))
        exact = apart.select("digest", "body", "locator").join(exact, ["digest", "body"]).select("locator", "exact_stay", "exact_size")
        out = out.join(exact, "locator", "left").withColumn("stay", F.coalesce("exact_stay", "stay")).withColumn("group_size", F.coalesce("exact_size", "group_size"))
    return out.select(
        "doc_id",
        F.col("stay.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("locator") == F.col("stay.locator")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        "locator",
    )
