from pyspark.sql import functions as F

from crivo.operators import sampling as SA
from crivo.operators.ranking import hash_rank


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def labelled(spark, pos, neg):
    return spark.range(pos + neg).select(F.col("id").alias("doc_id"), (F.col("id") < pos).cast("int").alias("label"))


def test_rank_is_a_permutation_whatever_the_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    ranks = [{r.doc_id: r.rank for r in hash_rank(df.repartition(p), "doc_id", 42).collect()} for p in (1, 8, 64)]
    assert ranks[0] == ranks[1] == ranks[2] and sorted(ranks[0].values()) == list(range(1, 501))


def test_ratio_sets_nest(spark):
    sets = SA.ratio_undersample(labelled(spark, 270, 28715), {"natural": None, "1a64": 64.0, "1a10": 10.0}).persist()
    r = {x.set_name: (x.pos, x.neg, x.total) for x in SA.set_report(sets).collect()}
    assert r == {"natural": (270, 28715, 28985), "1a64": (270, 17280, 17550), "1a10": (270, 2700, 2970)}
    by = {n: ids(sets.where(F.col("set_name") == n)) for n in r}
    assert by["1a10"] < by["1a64"] < by["natural"]


def test_caps_nest(spark):
    sizes = {"a": 261, "b": 62, "c": 29, "d": 5, "e": 1}
    rows = [(i * 1000 + j, s, 1) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, label int")
    small, large = SA.capped_positive_sample(df, 12), SA.capped_positive_sample(df, 29)
    count = lambda d: {r.source: r["count"] for r in d.groupBy("source").count().collect()}
    assert count(small) == {"a": 12, "b": 12, "c": 12, "d": 5, "e": 1}
    assert count(large) == {"a": 29, "b": 29, "c": 29, "d": 5, "e": 1}
    assert ids(small) < ids(large)


def test_cap_is_applied_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit(1).alias("label"))
    plan = SA.capped_positive_sample(df, 12)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_large_caps_rank_without_a_group_task(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), F.lit(1).alias("label"))
    small, large = SA.capped_positive_sample(df, 900), SA.capped_positive_sample(df, 1200)
    assert small.count() == 1800 and large.count() == 2400 and ids(small) < ids(large)


def test_exposure_counts_round_half_even(spark):
    pool = spark.createDataFrame(
        [(i, f"s{i % 2}", 1) for i in range(4)] + [(100 + i, "n", 0) for i in range(50)], "doc_id bigint, source string, label int"
    )
    train = labelled(spark, 4, 10)
    sets = SA.exposure_sets(pool, train, {"natural": (1, None), "1a3": (2, 3.0)})
    assert {r.set_name: (r.pos, r.neg) for r in SA.set_report(sets).collect()} == {"natural": (2, 5), "1a3": (4, 12)}


def test_folds_and_oversampling(spark):
    df = labelled(spark, 13, 87)
    folds = SA.stratified_folds(df, 5).groupBy("fold", "label").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in folds if r.label == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    over = SA.ratio_oversample(df, 2.0)
    assert over.where("label = 1").count() == 43 and over.where("label = 0").count() == 87
    assert ids(over.where("label = 1")) == set(range(13))
