"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch is a table of changes. Each change becomes signed additions: an insert adds a document and its tokens, a delete
takes them away, a revision adds the difference. Folded by key they are the batch's delta, a small table under the
rollup's folder. It is written under a temporary name and renamed to its batch's name, which either happens or does
not: a batch that is there already is not applied again, whoever repeats it. Totals are sums of deltas, so batches may
arrive in any order. `compact` folds the deltas that are there into one base that names them.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.session import publish

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def changes(docs: DataFrame, kind: str, version: str, tokens: Column | None = None, was: Column | None = None) -> DataFrame:
    """Changes of one kind for all rows of `docs` (source, lang, ...): insert (tokens), delete (was), revise (both)."""
    none = F.lit(None).cast("long")
    return docs.select(
        F.lit(kind).alias("kind"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"),
        (none if tokens is None else tokens.cast("long")).alias("tokens"),
        (none if was is None else was.cast("long")).alias("was"),
    )


def signed(batch: DataFrame) -> DataFrame:
    """A batch's delta: one row per key with the documents and tokens to add, which may be negative.

    A null count is 0, a null source, lang or version is a key of its own, a row of another kind changes nothing.
    Repeated rows count as often as they are there; an empty batch adds nothing.
    """
    kind, tokens, was = F.col("kind"), F.coalesce("tokens", F.lit(0)), F.coalesce("was", F.lit(0))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    add = F.when(kind == "insert", tokens).when(kind == "delete", -was).when(kind == "revise", tokens - was).otherwise(0)
    return batch.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(add).cast("long").alias("n_tokens"))


class Rollup:
    """Additive totals under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._where(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _where(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._where(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _publish(self, df: DataFrame, name: str) -> bool:
        """Write under a temporary name, then rename; false if `name` was there first, also if another committer was faster."""
        temporary = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        df.write.parquet(temporary)
        done = publish(self.spark, temporary, f"{self.path}/{name}")
        if not done:
            self._fs.delete(self._where(temporary), True)
        return done

    def _base(self) -> str | None:
        return next(reversed(self._names("base")), None)

    def _folded(self) -> set[str]:
        """Batches that the base holds."""
        base = self._base()
        if base is None:
            return set()
        return {r["batch"] for r in self.spark.read.parquet(f"{self.path}/base/{base}/batches").collect()}

    def batches(self) -> set[str]:
        """Names of all batches applied so far."""
        return self._folded() | set(self._names("deltas"))

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Apply a batch of changes (kind, source, lang, version, tokens, was); false if it was applied before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"no name for a batch: {batch_id!r}")
        return batch_id not in self.batches() and self._publish(signed(batch), f"deltas/{batch_id}")

    def totals(self) -> DataFrame:
        """One row per source, lang and version that any batch has named: n_docs, n_tokens."""
        base, folded = self._base(), self._folded()
        paths = [f"{self.path}/base/{base}/totals"] if base else []
        paths += [f"{self.path}/deltas/{b}" for b in self._names("deltas") if b not in folded]
        parts = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Fold all deltas there are into a new base, which takes the place of the old one by a rename."""
        folded, number = self.batches(), len(self._names("base"))
        work = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{work}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(folded)], "batch string").write.parquet(f"{work}/batches")
        if not publish(self.spark, work, f"{self.path}/base/{number:09d}"):
            raise RuntimeError("another compaction came first")
        for b in folded & set(self._names("deltas")):  # the base names them, so a reader in between counts them once
            self._fs.delete(self._where(f"{self.path}/deltas/{b}"), True)
