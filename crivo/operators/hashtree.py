"""Comparing two versions of a table by trees of hashes, so that only what differs is read.

Rows fall into buckets by the hash of their key. A bucket's fingerprint is the sum of its rows' hashes, whatever their order; a
node's is the sum of its children's. Two versions are compared from the root down, into differing nodes only, and just the
buckets that differ are read and joined. The rows of equal buckets are known to be equal from the tree alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.operators.leakage import reconcile_counts, reconciled

DEPTH = 2  # hex digits of a bucket's name: 16 ** DEPTH buckets


def _bucket(key: str, depth: int) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, depth)


def hash_tree(rows: DataFrame, columns: Sequence[str], key: str = "url", depth: int = DEPTH, bucket: str | None = None) -> DataFrame:
    """(node, rows, keyless, a, b) for the root "" and all nodes down to the buckets; a and b are sums of parts of each row's md5."""
    cells = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in (key, *columns)]
    mark = F.md5(F.concat_ws(",", *cells))
    parts = [F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)").alias(n) for at, n in ((1, "a"), (16, "b"))]
    keyless = (F.coalesce(F.col(key).cast("string"), F.lit("")) == "").cast("int").alias("keyless")
    leaves = rows.select((F.col(bucket) if bucket else _bucket(key, depth)).alias("leaf"), keyless, *parts)
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")]
    leaves = leaves.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum("keyless").alias("keyless"), *sums)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = leaves.withColumn("_level", levels).withColumn("node", F.expr("substring(leaf, 1, _level)"))
    return nodes.groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("keyless").alias("keyless"), *sums)


def write_hashed(rows: DataFrame, path: str, columns: Sequence[str], key: str = "url", depth: int = DEPTH) -> str:
    """Write `rows` by bucket, and the tree of their hashes (at most 2 * 16 ** depth rows) beside them."""
    dealt = rows.withColumn("_bucket", F.concat(F.lit("h"), _bucket(key, depth)))
    dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").withColumn("_leaf", F.substring("_bucket", 2, depth))
    hash_tree(written, columns, key, depth, "_leaf").write.parquet(f"{path}/tree")
    return path


def differing(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> list[str]:
    """The buckets whose fingerprints differ between two trees: from each differing node down to its children."""
    a, b = (t.withColumnsRenamed({c: f"{s}_{c}" for c in t.columns if c != "node"}) for t, s in ((old, "old"), (new, "new")))
    same = F.lit(True)
    for c in ("rows", "a", "b"):
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    pairs = a.join(b, "node", "full").where(~same)
    found = [""]
    for level in range(depth + 1):
        asked = pairs.where((F.length("node") == level) & F.substring("node", 1, max(level - 1, 0)).isin(found))
        found = sorted(r["node"] for r in asked.select("node").collect())  # 16 ** depth at most
        if not found:
            break
    return found


def reconcile_by_tree(spark: SparkSession, old: str, new: str, columns: Sequence[str], key: str = "url", depth: int = DEPTH) -> DataFrame:
    """What `reconcile_versions` says of two tables that `write_hashed` wrote, reading only the buckets that differ.

    Keys are unique; rows without one match nothing, in equal buckets too.
    """
    trees = [spark.read.parquet(f"{p}/tree") for p in (old, new)]
    buckets = differing(*trees, depth)
    names = [f"h{b}" for b in buckets]
    sides = [spark.read.parquet(f"{p}/rows").where(F.col("_bucket").isin(names)).drop("_bucket") for p in (old, new)]
    counts = reconcile_counts(*sides, columns, key)
    equal = trees[0].where((F.length("node") == depth) & ~F.col("node").isin(buckets))
    n, lone = F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("keyless"), F.lit(0))
    known = {"old_rows": n, "new_rows": n, "matched": n - lone, "only_old": lone, "only_new": lone, "same_text": n - lone}
    rest = equal.agg(*[known.get(c, F.lit(0)).cast("bigint").alias(c) for c in counts.columns])
    both = counts.unionByName(rest)
    return reconciled(both.agg(*[F.sum(c).alias(c) for c in counts.columns]), "text" in columns)
