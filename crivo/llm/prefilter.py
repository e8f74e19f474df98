"""Thinning of a large table before it is shuffled to meet a smaller one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITS = 23


def drop_absent(rows: DataFrame, wanted: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Drop rows whose key surely is not in `wanted`, by a broadcast bit table of fixed size. Some absent ones may stay."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    table = wanted.select(place.alias("place")).groupBy(F.expr("place div 64").alias("_word"))
    table = table.agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("_bits"))
    marked = rows.withColumn("_place", place).withColumn("_word", F.expr("_place div 64"))
    kept = marked.join(F.broadcast(table), "_word")  # 2 ** (bits - 6) rows at most
    return kept.where("shiftright(_bits, cast(_place % 64 AS int)) & 1 = 1").select(rows.columns)
