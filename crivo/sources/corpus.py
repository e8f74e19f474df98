"""Split corpus tables: typed scans, null policy, column contract, optional inputs, versioned sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SPLITS = ("train", "dev", "test")
EMPTY_SOURCE = "(vazio)"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("processed_text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("portal", T.StringType()),
    ]
)
DOCUMENT_COLUMNS = ("url", "text", "label", "source", "split")


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df


def split_rank(split: Column | str) -> Column:
    """0, 1, 2 for train, dev, test; other values come last."""
    split = F.col(split) if isinstance(split, str) else split
    rank = F.lit(len(SPLITS))
    for i, s in enumerate(SPLITS):
        rank = F.when(split == s, i).otherwise(rank)
    return rank


def apply_null_policy(df: DataFrame) -> DataFrame:
    """Empty url and text for NULL, a marker for a NULL source, integer labels."""
    return df.withColumns(
        {
            "url": F.coalesce("url", F.lit("")),
            "text": F.coalesce("text", F.lit("")),
            "source": F.coalesce("source", F.lit(EMPTY_SOURCE)),
            "label": F.col("label").cast("int"),
        }
    )


def _read_columns(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The table at `path`; csv columns are found by name in the header and typed by RAW_SCHEMA."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    options = {"header": True, "multiLine": True, "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    types = {f.name: f.dataType for f in RAW_SCHEMA}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names])
    return spark.read.options(**options, mode="FAILFAST").csv(path, schema=schema)


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "csv", key: str | None = None) -> DataFrame:
    """One split, as doc_id, url, text, label, source, split.

    `key` names a unique integer column. Without one, the key follows the file order: it is stable while the
    files stay as they are, so give a table that is rewritten or merged a key of its own.
    """
    raw = require_columns(_read_columns(spark, path, fmt), [*RAW_SCHEMA.names, *([key] if key else [])], path)
    start = SPLITS.index(split) << 58
    doc_id = F.col(key).cast("bigint") if key else F.monotonically_increasing_id() + F.lit(start)
    df = raw.select(
        doc_id.alias("doc_id"), "url", F.col("processed_text").alias("text"), "label", F.col("portal").alias("source")
    )
    return apply_null_policy(df).withColumn("split", F.lit(split))


def read_corpus(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", key: str | None = None) -> DataFrame:
    """Stack train, dev and test. A missing split is an error."""
    missing = [s for s in SPLITS if s not in paths]
    if missing:
        raise ValueError(f"missing splits {missing}")
    parts = [read_split(spark, paths[s], s, fmt, key) for s in SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The table at `path`, or an empty one of the same schema when the path does not exist."""
    try:
        options = {"header": True, "multiLine": True, "escape": '"'} if fmt == "csv" else {}
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_training_state(spark: SparkSession, path: str) -> DataFrame:
    """Trainer state as rows of (best_model_checkpoint, position, epoch, loss, eval_loss, eval_f1)."""
    schema = (
        "best_model_checkpoint string, "
        "log_history array<struct<epoch:double, loss:double, eval_loss:double, eval_f1:double>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select("best_model_checkpoint", F.posexplode_outer("log_history").alias("position", "entry")).select(
        "best_model_checkpoint", "position", "entry.*"
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = ()) -> str:
    """Write a result table as many files as it has partitions; text formats keep a header and quote newlines."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', quoteAll=True)
    else:
        writer.format(fmt).save(path)
    return path


def write_version(new: DataFrame, changed: DataFrame, base: str, version: int, fmt: str = "parquet") -> str | None:
    """Write `new` as `base/v<version>` when `changed` has rows; return its path, or None when nothing changed.

    Spark cannot overwrite a path it is reading, so a rewrite is a new version beside the old one.
    """
    if changed.isEmpty():
        return None
    return write_table(new, f"{base.rstrip('/')}/v{version}", fmt)
