"""Global order without a global sort: ranks and running sums split over buckets.

A window without a partition, or over one hot group, sends its rows to one task. Here rows fall into ordered
buckets first; only per-bucket totals (a table of bounded size) are summed in order, and each bucket is ordered on
its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crivo.operators.relational import join_nullsafe, with_row

SCORE_BUCKETS = 64


def seeded_hash(seed, key: Column | str) -> Column:
    """Hex md5 of 'seed:key': the random order of every sample. Any prefix of it is a nested sample."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_rank(df: DataFrame, key: str, seed, by: Sequence[str] = (), out: str = "rank", digits: int = 3) -> DataFrame:
    """Add the 1-based rank of each row in seeded-hash order, per group `by`; NULL is a group like any other.

    Buckets are the first `digits` hex digits, so they are even whatever the key or group looks like, and the
    offsets are at most 16**digits rows per group. Pass narrow rows: they are shuffled once.
    """
    by = list(by)
    rows = df.withColumn("_h", seeded_hash(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_b").orderBy("_h", key)
    return (
        join_nullsafe(rows, starts, [*by, "_b"])
        .withColumn(out, F.col("_start") + F.row_number().over(within))
        .drop("_h", "_b", "_start")
    )


def score_points(preds: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows and positives per distinct score: everything the ranking metrics need, combined before any shuffle."""
    return preds.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )


def running_points(points: DataFrame, by: Sequence[str] = (), buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Score points with running totals from the highest score down.

    Adds tp and fp (rows at or above the score), total_n, total_pos, and next_score (the next higher score).
    Buckets are approximate quantiles of the distinct scores; their edges only balance the work and never change
    the result. `by` names evaluation sets, of which there are few: one row of edges per set is broadcast.
    """
    by = list(by)
    probs = [i / buckets for i in range(1, buckets)]
    edges = points.groupBy(*by).agg(F.percentile_approx("score", probs, 1000).alias("_edges"))
    edged = join_nullsafe(points, F.broadcast(edges), by) if by else with_row(points, edges)
    spread = edged.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("score")))).drop("_edges")
    totals = spread.groupBy(*by, "_b").agg(
        F.sum("n").alias("_bn"), F.sum("pos").alias("_bp"), F.min("score").alias("_bmin")
    )
    whole_set = by or [F.lit(0)]
    above = Window.partitionBy(*whole_set).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*whole_set)
    offsets = totals.select(
        *by,
        "_b",
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_n_above"),
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_p_above"),
        F.sum("_bn").over(whole).alias("total_n"),
        F.sum("_bp").over(whole).alias("total_pos"),
        F.lag("_bmin").over(Window.partitionBy(*whole_set).orderBy(F.desc("_b"))).alias("_min_above"),
    )
    down = Window.partitionBy(*by, "_b").orderBy(F.desc("score"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    # At most `buckets` rows per evaluation set.
    return join_nullsafe(spread, F.broadcast(offsets), [*by, "_b"]).select(
        *by,
        "score",
        "n",
        "pos",
        (F.col("_p_above") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("_n_above") + F.sum("n").over(upto) - F.col("_p_above") - F.sum("pos").over(upto)).alias("fp"),
        "total_n",
        "total_pos",
        F.coalesce(F.lag("score").over(down), F.col("_min_above")).alias("next_score"),
    )
