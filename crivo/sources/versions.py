"""A table in versions, rewritten by copying only the files that change.

Data files are never touched. A version is a manifest: the list of the files it is made of. A rewrite reads only the files
that hold a changed row, writes their new content to new files, and publishes a manifest of the old files that stayed
and the new ones by one rename that fails if another writer took the version first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.session import publish


class VersionConflict(RuntimeError):
    """Another writer published the version first."""


class VersionedTable:
    """A parquet table under `base`, a folder the cluster shares. Readers see the version they ask for, or the latest."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def files(self, version: int | None = None) -> list[str]:
        """The data files of a version, as folder/name under `data`; as long as the list of files of any table is."""
        version = self.versions()[-1] if version is None else version
        return sorted(r[0] for r in self.spark.read.text(f"{self.base}/manifests/{version:09d}").collect())

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.base}/data/{f}" for f in self.files(version)])

    def _write(self, df: DataFrame) -> list[str]:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.base}/data/{folder}")
        written = self.spark.read.parquet(f"{self.base}/data/{folder}").inputFiles()
        return [f"{folder}/{f.rpartition('/')[2]}" for f in written]

    def _publish(self, version: int, files: list[str]) -> int:
        work = f"{self.base}/_work/{uuid.uuid4().hex}"
        rows = self.spark.createDataFrame([(f,) for f in sorted(files)], "value string")
        rows.coalesce(max(1, len(files) // 100_000)).write.text(work)
        if not publish(self.spark, work, f"{self.base}/manifests/{version:09d}"):
            raise VersionConflict(f"{self.base}: version {version} is there already")
        return version

    def create(self, df: DataFrame) -> int:
        """Write `df` as version 0."""
        return self._publish(0, self._write(df))

    def rewrite(self, changed: Column, change: Callable[[DataFrame], DataFrame]) -> int | None:
        """Apply `change` to the rows of every file with a row where `changed` holds, as a new version.

        None if no row changes: nothing is written then, so a second run of a repeatable change does nothing.
        """
        last = self.versions()[-1]
        current, schema = self.files(last), self.read(last).schema
        name = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1)
        touched = {r[0] for r in self.read(last).where(changed).select(name.alias("f")).distinct().collect()}  # names of files
        if not touched:
            return None
        rows = self.spark.read.schema(schema).parquet(*[f"{self.base}/data/{f}" for f in sorted(touched)])
        return self._publish(last + 1, [f for f in current if f not in touched] + self._write(change(rows)))
