"""NULL groups, caps of any size, and top-k cuts."""

import pytest
from pyspark.sql import functions as F

from crivo.operators import leakage as L, modeling as ML, profile as P, ranking as R, sampling as SA
from crivo.operators.tfidf import most_frequent


@pytest.mark.parametrize("cap", [3, 1000, 1001, 5000])
def test_capped_sample_keeps_rows_without_source(spark, cap):
    rows = [(i, None if i % 2 else f"s{i % 4}", 1) for i in range(10)]
    got = SA.capped_positive_sample(spark.createDataFrame(rows, "doc_id long, source string, label int"), cap)
    assert got.count() == (10 if cap > 5 else 3 + 3 + 2) and dict(got.dtypes)["pick"] == "int"


def test_hash_rank_ranks_null_groups(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "a") for i in range(12)], "k long, g string")
    ranks = R.hash_rank(df, "k", 1, by=["g"]).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert {r["g"]: r["r"] for r in ranks} == {None: [1, 2, 3, 4, 5], "a": [1, 2, 3, 4, 5, 6, 7]}


def test_exact_dedup_splits_the_table_also_for_null_texts(spark):
    rows = [(1, "train", 0, None, "s"), (2, "dev", 0, None, "s"), (3, "dev", 1, "t", "s"), (4, "test", 1, "u", "s")]
    df = spark.createDataFrame(rows, "doc_id long, split string, label int, text string, source string")
    kept = {r.doc_id for r in L.exact_dedup(df).collect()}
    gone = {r.doc_id for r in L.exact_dedup_removed(df).collect()}
    assert kept == {1, 3, 4} and gone == {2}


def test_most_frequent_cuts_ties_by_term(spark):
    rows = [(f"{a}{b}{i}", total) for a in "xyz" for b in "ab" for i in range(40) for total in (5,)] + [("top", 9), ("zz", 7), ("low", 1)]
    df = spark.createDataFrame(rows, "term string, total long")
    want = [t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for k in (1, 2, 3, 50, 121, 242, 243, 1000):
        assert sorted(r.term for r in most_frequent(df, k).collect()) == sorted(want[:k])


def test_reconcile_ignores_empty_keys(spark):
    schema = "url string, text string, label int"
    a = spark.createDataFrame([("", "a", 1), ("", "b", 1), (None, "c", 1), ("u", "x  y", 1), ("v", "z", 0)], schema)
    b = spark.createDataFrame([("", "a", 1), ("u", "x y", 0), ("w", "q", 0)], schema)
    r = L.reconcile_versions(a, b, ["text", "label"]).first()
    assert (r.old_rows, r.new_rows, r.matched, r.only_old, r.only_new) == (5, 3, 1, 4, 2)
    assert (r.diff_text, r.diff_label, r.text_equal_pct) == (1, 1, 100.0)


def test_histogram_has_a_class_for_rows_without_label(spark):
    df = spark.createDataFrame([(None, "x" * 150), (1, "x" * 150), (1, "y")], "label int, text string")
    got = P.length_histogram(df).groupBy("label").agg(F.sum("n").alias("n"), F.max("total").alias("t")).collect()
    assert {r.label: (r.n, r.t) for r in got} == {None: (1, 1), 1: (1, 2)}


def test_sorted_page_and_oversampled_folds(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 4) for i in range(9)], "doc_id long, v int")
    assert [r.doc_id for r in P.sorted_page(df, "v", True, 0, 4).collect()] == [7, 2, 6, 1]
    assert [r.doc_id for r in P.sorted_page(df, "v", False, 2, 4).collect()] == [3]
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "doc_id long, label int")
    out = SA.oversampled_folds(rows, 2.0, 5).toPandas()
    for k, part in out.groupby("fold"):
        train, held = part[part.role == "train"], part[part.role == "valid"]
        assert not set(train.doc_id) & set(held.doc_id) and len(set(part.doc_id)) == 100
        assert (train.label == 1).sum() == (train.label == 0).sum() // 2


def test_lexicon_is_the_log_odds_of_presence(spark):
    rows = [(i, int(i < 10), ("bad word " if i < 8 else "") + "same text") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    got = {r.term: r.weight for r in ML.lexicon(df, min_df=5).collect()}
    from math import log

    assert got["bad"] == round(10000 * log((9 / 12) / (1 / 22))) and got["same"] == round(10000 * log((11 / 12) / (21 / 22)))
    scores = {r.doc_id: r.score for r in ML.lexicon_scores(df, ML.lexicon(df)).collect()}
    assert scores[0] > scores[9] and len(scores) == 30
