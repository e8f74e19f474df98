"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, form blocks. With b of all m blocks, block i of a source (from 1) is released at
slot floor((i - 1) m / b) and due by slot ceil(i m / b). Every slot takes the released block with the earliest deadline,
so after any number of slots a source is less than one block away from its share: all windows of all sources can be met.

The number of blocks is bounded (`max_blocks`, plus one per source), so their size grows with the corpus and the
schedule is one small row, computed once by a fold over the slots. What the target weights leave of a source can follow as
further blocks: they are scheduled the same way, by the shares of what is left, from the mixture's last slot on. Which document belongs to which block comes from
counts per hash bucket, so no source's documents are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from crivo.operators.ranking import seeded_hash
from crivo.session import materialise

MAX_BLOCKS = 2048
#: Target weights, when none are given: every source's own share, but at most this share of the documents for one.
MAX_SHARE = 0.25
BUCKET_ROWS = 20_000


def quotas(docs: DataFrame, weights: dict[str, float] | None = None, max_share: float = MAX_SHARE) -> DataFrame:
    """(source, n, quota): documents there are, and documents that the mixture takes at the target weights.

    The mixture is as long as the weights allow without repeating a document: a source that limits it is used up.
    Given weights are relative; a source without one is left out of the mixture.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        total = counts.groupBy().agg(F.sum("n").alias("total")).scalar()
        return counts.select("source", "n", F.least("n", F.ceil(F.lit(max_share) * total)).cast("long").alias("quota"))
    pairs = [(s, float(w)) for s, w in weights.items() if w > 0]
    target = docs.sparkSession.createDataFrame(pairs, "name string, weight double")
    counts = counts.join(F.broadcast(target), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    length = counts.where("weight IS NOT NULL").groupBy().agg(F.min(F.col("n") / F.col("weight")).alias("length")).scalar()
    taken = F.floor(F.col("weight") * length + F.lit(1e-9))
    return counts.select("source", "n", F.coalesce(F.least("n", taken), F.lit(0)).cast("long").alias("quota"))


def schedule(blocks: DataFrame) -> DataFrame:
    """Slots for `blocks` (source, n_blocks): source, block (from 0), release, deadline, slot.

    One row per block. Ties of deadlines go to the first source in order, null first.
    """
    listed = blocks.where("n_blocks > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "n_blocks"))).alias("s"), F.sum("n_blocks").cast("long").alias("m"))
    # the fold carries the blocks each source has had; a released block's deadline orders the choice
    pick = (
        "aggregate(sequence(1, size(s)), struct(cast(0 AS bigint) AS due, 0 AS at), (best, k) -> "
        "CASE WHEN done[k - 1] < s[k - 1].n_blocks AND (done[k - 1] * m) div s[k - 1].n_blocks <= t "
        "AND (best.at = 0 OR ((done[k - 1] + 1) * m + s[k - 1].n_blocks - 1) div s[k - 1].n_blocks < best.due) "
        "THEN struct(((done[k - 1] + 1) * m + s[k - 1].n_blocks - 1) div s[k - 1].n_blocks AS due, k AS at) ELSE best END).at"
    )
    pick = pick.replace("done[", "acc.done[")
    fold = (
        "aggregate(sequence(cast(0 AS bigint), m - 1), "
        "struct(transform(s, x -> cast(0 AS bigint)) AS done, cast(array() AS array<int>) AS picks), (acc, t) -> "
        f"transform(array({pick}), a -> struct(transform(acc.done, (d, i) -> CASE WHEN i = a - 1 THEN d + 1 ELSE d END) AS done, "
        "concat(acc.picks, array(a)) AS picks))[0]).picks"
    )
    picked = listed.where("m > 0").withColumn("picks", F.expr(fold))
    slots = picked.select("s", "m", F.posexplode("picks").alias("slot", "at"))
    slots = slots.select(F.expr("s[at - 1].source").alias("source"), F.expr("s[at - 1].n_blocks").alias("n_blocks"), "m", F.col("slot").cast("long").alias("slot"))
    order = W.partitionBy("source").orderBy("slot")
    slots = slots.withColumn("block", (F.row_number().over(order) - 1).cast("long"))
    return slots.select(
        "source",
        "block",
        F.expr("(block * m) div n_blocks").alias("release"),
        F.expr("((block + 1) * m + n_blocks - 1) div n_blocks").alias("deadline"),
        "slot",
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    max_share: float = MAX_SHARE,
    max_blocks: int = MAX_BLOCKS,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 0,
    excess: bool = False,
) -> DataFrame:
    """Interleave the sources of `docs` (doc_id, source, ...) at target weights.

    Returns the rows in the mixture with all their columns and _block (within the source), _release, _deadline, _slot
    and _place (position in the block). Reading by _slot, then _place gives the mixture. Columns of these names in
    `docs` are replaced. Without weights a source keeps its share, but at most `max_share` of the documents of one. What is over a source's
    target stays out or, with `excess`, follows the mixture in blocks and slots of its own, so that every row is there once.
    A source's documents are taken in the order of md5 of `seed:doc_id`, then doc_id; rows that repeat a doc_id are ordered
    by a hash of their other columns. A null source is a source of its own, and a null doc_id an identifier of its
    own. Texts are not looked into, so empty and long ones are alike. An empty table gives no rows.
    """
    names = docs.columns
    docs = docs.drop("_block", "_release", "_deadline", "_slot", "_place")
    names = [n for n in names if n in docs.columns]
    others = [F.col(f"`{n}`") for n in names if n != "doc_id"]
    marked = docs.withColumn("_hash", seeded_hash(seed, "doc_id")).withColumn("_tie", F.xxhash64(*others) if others else F.lit(0))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null-safe
    marked = marked.withColumn("_source", key)

    taken = materialise(quotas(docs, weights, max_share), "quotas")
    wanted, rows = taken.agg(F.sum("quota"), F.sum("n")).first()
    buckets = 1 + (rows or 0) // bucket_rows  # ranges of the hash, so they change no order
    marked = marked.withColumn("_bucket", F.expr(f"(cast(conv(substr(_hash, 1, 8), 16, 10) AS bigint) * {buckets}) div {1 << 32}"))
    size = -(-(wanted or 0) // max_blocks) or 1
    sized = taken.withColumn("n_blocks", F.expr(f"(quota + {size - 1}) div {size}"))
    plan = schedule(sized.select("source", "n_blocks")).withColumn("_late", F.lit(False))
    late_size = 1
    if excess:
        late_size = -(-((rows or 0) - (wanted or 0)) // max_blocks) or 1
        sized = sized.withColumn("late_blocks", F.expr(f"(n - quota + {late_size - 1}) div {late_size}"))
        slots = sized.agg(F.sum("n_blocks")).first()[0] or 0
        late = schedule(sized.select("source", F.col("late_blocks").alias("n_blocks"))).withColumn("_late", F.lit(True))
        plan = plan.union(late.withColumns({c: F.col(c) + slots for c in ("release", "deadline", "slot")}))
    plan = materialise(plan, "schedule")
    plan = plan.withColumn("_source", key).drop("source")

    counts = marked.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    order = W.partitionBy("_source").orderBy("_bucket")
    before = counts.select("_source", "_bucket", (F.sum("n").over(order) - F.col("n")).alias("_before"))
    sized = sized.withColumn("_source", key).select("_source", "quota", "n_blocks")
    before = before.join(sized, "_source").where(F.lit(excess) | (F.col("_before") < F.col("quota")))
    rank = F.row_number().over(W.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "_tie"))
    placed = marked.withColumn("_rank", rank - 1).join(before, ["_source", "_bucket"])
    placed = placed.withColumn("_at", F.col("_before") + F.col("_rank")).withColumn("_late", F.expr("_at >= quota"))
    placed = placed if excess else placed.where("NOT _late")
    placed = placed.withColumn("block", F.expr(f"CASE WHEN _late THEN (_at - quota) div {late_size} ELSE _at div {size} END"))
    placed = placed.withColumn("_place", F.expr(f"CASE WHEN _late THEN (_at - quota) % {late_size} ELSE _at % {size} END"))
    out = placed.join(F.broadcast(plan), ["_source", "_late", "block"])  # max_blocks rows and one per source, or twice that, at most
    number = F.expr("block + CASE WHEN _late THEN n_blocks ELSE 0 END").alias("_block")
    mine = [number, *(F.col(a).alias(b) for a, b in (("release", "_release"), ("deadline", "_deadline"), ("slot", "_slot")))]
    return out.select(*[F.col(f"`{n}`") for n in names], *mine, "_place")
