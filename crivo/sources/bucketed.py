"""Tables stored in buckets of their key, so that joins on it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from crivo.session import scratch


def write_bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None, table: str | None = None) -> str:
    """Write `df` as a table of `buckets` buckets, each sorted by `key`; the table's name.

    The work of one shuffle is paid here, once; every later join, grouping or anti join on `key` with a table of as many
    buckets reads matching buckets side by side. A key with a large share of the rows makes its bucket large.
    """
    table = table or f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key)  # one file a bucket
    writer = rows.write.bucketBy(buckets, key).sortBy(key).option("path", path or scratch(df.sparkSession, "bucketed"))
    writer.format("parquet").saveAsTable(table)
    return table
