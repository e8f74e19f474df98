"""Reproducible, nested samples. Every random order is md5 of 'seed:key', so any prefix is a subset of a longer one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from crivo.operators.ranking import hash_rank, seeded_hash
from crivo.operators.relational import with_row
from crivo.session import materialise
from crivo.sources.corpus import write_table

NATURAL = "natural"


def domain_partition(df: DataFrame, dominant: Sequence[str]) -> DataFrame:
    """Adds `domain`: 'in' for the dominant sources, 'pool' for all others."""
    return df.withColumn("domain", F.when(F.col("source").isin(*dominant), "in").otherwise("pool"))


def capped_positive_sample(df: DataFrame, cap: int, seed=42) -> DataFrame:
    """Up to `cap` positives per source, adding `pick`; a smaller cap gives a subset. A NULL source is one source.

    Spark keeps `cap` rows per source in each task before the shuffle, so a hot source does not pile up; it does so for caps
    up to spark.sql.optimizer.windowGroupLimitThreshold, which is 1000 unless set higher.
    """
    w = Window.partitionBy("source").orderBy(seeded_hash(seed, "doc_id"), "doc_id")
    return df.where("label = 1").withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= cap)


def ratio_undersample(df: DataFrame, ratios: Mapping[str, float | None], seed=42, key: str = "doc_id") -> DataFrame:
    """All positives plus, per named ratio, the first n_pos * ratio negatives of one hash order.

    None keeps every negative. Returns (set_name, key, label); smaller ratios are subsets of larger ones.
    """
    narrow = df.select(key, "label")
    ranked = hash_rank(narrow.where("label = 0"), key, seed)
    n_pos = narrow.agg(F.count_if(F.col("label") == 1).alias("n_pos"))
    cuts = F.array(
        *[F.struct(F.lit(n).alias("set_name"), F.lit(r).cast("double").alias("ratio")) for n, r in ratios.items()]
    )
    negatives = (
        with_row(ranked, n_pos)
        .select(key, "label", "rank", "n_pos", F.explode(cuts).alias("c"))
        .where(F.col("c.ratio").isNull() | (F.col("rank") <= F.col("n_pos") * F.col("c.ratio")))
        .select(F.col("c.set_name").alias("set_name"), key, "label")
    )
    names = F.array(*[F.lit(n) for n in ratios])
    positives = narrow.where("label = 1").select(F.explode(names).alias("set_name"), key, "label")
    return positives.unionByName(negatives)


def exposure_sets(
    pool: DataFrame,
    train: DataFrame,
    specs: Mapping[str, tuple[int, float | None]],
    seed=42,
    key: str = "doc_id",
) -> DataFrame:
    """Out-of-domain evaluation sets: capped positives and nested negatives.

    `specs` maps a set name to (cap per source, ratio). Ratio None takes the natural ratio of `train`; the count
    n_pos * n_neg_train / n_pos_train is rounded half to even.
    """
    narrow = pool.select(key, "source", "label")
    largest = max(cap for cap, _ in specs.values())
    picks = capped_positive_sample(narrow, largest, seed)
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("set_name"), F.lit(cap).alias("cap"), F.lit(r).cast("double").alias("ratio"))
            for n, (cap, r) in specs.items()
        ]
    )
    positives = (
        picks.select(key, "label", "pick", F.explode(cells).alias("c"))
        .where(F.col("pick") <= F.col("c.cap"))
        .select(F.col("c.set_name").alias("set_name"), key, "label", F.col("c.ratio").alias("ratio"))
    )
    natural = train.agg(
        F.count_if(F.col("label") == 0).alias("tn"), F.count_if(F.col("label") == 1).alias("tp")
    )
    counts = with_row(positives.groupBy("set_name", "ratio").agg(F.count(F.lit(1)).alias("n_pos")), natural)
    ratio = F.coalesce("ratio", F.col("tn").cast("double") / F.col("tp"))
    limits = counts.select("set_name", F.bround(F.col("n_pos") * ratio, 0).cast("bigint").alias("n_neg"))
    ranked = hash_rank(narrow.where("label = 0").select(key, "label"), key, seed)
    # One row per set.
    sets = F.array(*[F.lit(n) for n in specs])
    negatives = (
        ranked.withColumn("set_name", F.explode(sets))
        .join(F.broadcast(limits), "set_name")
        .where(F.col("rank") <= F.col("n_neg"))
        .select("set_name", key, "label")
    )
    return positives.select("set_name", key, "label").unionByName(negatives)


def exposure_report(pool: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positives per source in the pool and among the selected rows, 0 where none was taken."""
    pos = pool.where("label = 1").select(key, "source")
    chosen = selected.where("label = 1").select(key).withColumn("_in", F.lit(1))
    return pos.join(chosen, key, "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("original"), F.count("_in").alias("selected")
    )


def set_report(sets: DataFrame) -> DataFrame:
    """Positives, negatives, total and negatives per positive of each set."""
    g = sets.groupBy("set_name").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
        F.count(F.lit(1)).alias("total"),
    )
    return g.withColumn("ratio", F.bround(F.try_divide(F.col("neg").cast("double"), F.col("pos")), 1))


def stratified_folds(df: DataFrame, folds: int = 5, seed=42, key: str = "doc_id") -> DataFrame:
    """Adds `fold` 0..folds-1; class shares differ by at most one row between folds."""
    ranked = hash_rank(df.select(key, "label"), key, seed, by=["label"])
    return ranked.select(key, "label", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def quick_sample(df: DataFrame, n: int, seed=0, key: str = "doc_id") -> DataFrame:
    """n random rows per split, all of a smaller split."""
    ranked = hash_rank(df.select(key, "split"), key, seed, by=["split"])
    return df.join(ranked.where(F.col("rank") <= n).select(key), key, "left_semi")


def ratio_oversample(df: DataFrame, ratio: float = 10.0, seed=42, key: str = "doc_id") -> DataFrame:
    """Repeat positives until negatives / positives = ratio: whole copies, then the first rows of the hash order.

    Adds `copy`. The negatives appear once; a class that is already large enough is left alone.
    """
    narrow = df.select(key, "label")
    totals = narrow.agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")
    ).withColumn("target", F.greatest(F.floor(F.col("n_neg") / F.lit(float(ratio))), F.col("n_pos")))
    pos = with_row(hash_rank(narrow.where("label = 1"), key, seed), totals)
    whole = F.floor(F.col("target") / F.col("n_pos"))
    extra = F.when(F.col("rank") <= F.col("target") - whole * F.col("n_pos"), 1).otherwise(0)
    copies = F.sequence(F.lit(1).cast("bigint"), whole + extra)
    pos = pos.select(key, "label", F.explode(copies).alias("copy")).withColumn("copy", F.col("copy").cast("int"))
    return pos.unionByName(narrow.where("label = 0").withColumn("copy", F.lit(1)))


def oversampled_folds(df: DataFrame, ratio: float = 10.0, folds: int = 5, seed=42, key: str = "doc_id") -> DataFrame:
    """(fold, role, key, label, copy): per stratified fold its held-out rows once, and the others with repeated positives.

    The repeats are drawn from the rows outside the fold only, so no held-out row is ever trained on.
    """
    assigned = materialise(stratified_folds(df, folds, seed, key), "folds")
    out = None
    for k in range(folds):
        train = ratio_oversample(assigned.where(F.col("fold") != k).select(key, "label"), ratio, seed, key)
        held = assigned.where(F.col("fold") == k).select(key, "label", F.lit(1).alias("copy"))
        part = train.withColumn("role", F.lit("train")).unionByName(held.withColumn("role", F.lit("valid")))
        part = part.select(F.lit(k).alias("fold"), "role", key, "label", "copy")
        out = part if out is None else out.unionByName(part)
    return out


def write_sets(sets: DataFrame, rows: DataFrame, path: str, key: str = "doc_id", fmt: str = "parquet") -> str:
    """Write the rows of every set, one folder per `set_name`."""
    return write_table(sets.select("set_name", key).join(rows, key), path, fmt, partition_by=["set_name"])


def leave_one_source_out(df: DataFrame) -> DataFrame:
    """Set sizes when each source in turn is held out: the source to test on, all rows less its own to train on."""
    sizes = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos")]
    whole = df.agg(*sizes).withColumnsRenamed({"n": "_n", "pos": "_pos"})
    per_source = with_row(df.where("source IS NOT NULL").groupBy(F.col("source").alias("held_out")).agg(*sizes), whole)
    test = F.struct(F.lit("test").alias("role"), "n", "pos")
    train = F.struct(F.lit("train").alias("role"), (F.col("_n") - F.col("n")).alias("n"), (F.col("_pos") - F.col("pos")).alias("pos"))
    return per_source.select("held_out", F.explode(F.array(train, test)).alias("s")).select("held_out", "s.*")


def without_source(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all other sources, rows of `source`)."""
    return df.where(F.col("source") != source), df.where(F.col("source") == source)
