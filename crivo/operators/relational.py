"""Join shapes the operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1000  # a key is hot above 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys
SALTS = 64


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table. It is a scalar subquery: evaluated once, no join."""
    value = row.select(F.struct(*row.columns).alias("_row")).scalar()
    wide = df.withColumn("_row", value)
    return wide.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left JOIN right USING keys, where NULL equals NULL."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(other, on, how).drop(*names.values())


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, unique: str) -> DataFrame:
    """rows JOIN groups ON key, NULL being a key, where one key may hold a third of the rows.

    `groups` has one row per key with its row count in `size`. Hot keys (at most HOT_SHARE of them, hence a
    broadcast of known size) get their rows spread over SALTS sub-keys and their group row repeated per sub-key.
    """
    sized = with_row(groups, groups.agg(F.sum(size).alias("_total")))
    hot = F.col(size) * HOT_SHARE > F.col("_total")
    salted = sized.withColumn(
        "_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_total")
    hot_keys = sized.where(hot).select(key, F.lit(True).alias("_hot"))
    spread = join_nullsafe(rows, F.broadcast(hot_keys), [key], "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(unique), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    return join_nullsafe(spread.drop("_hot"), salted, [key, "_salt"]).drop("_salt")
