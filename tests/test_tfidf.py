import re
from collections import Counter

import pytest

from crivo.operators import tfidf as T

TEXTS = ["Aa bb aa bb cc", None, "", "x", "bb cc dd aa bb cc", "dd dd dd dd", "Aa bb aa bb cc", "ee aa"]


def grams(text, low, high):
    words = re.findall(r"\w\w+", (text or "").lower())
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("words", [1, 1 << 20])
@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_term_totals_equal_a_plain_count(spark, monkeypatch, words, low, high):
    """Terms never reach across two texts, and come once per batch and value of `by`."""
    monkeypatch.setattr(T, "WORDS", words)
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(TEXTS)], "doc_id bigint, fold int, text string").coalesce(1)
    spec = T.TfidfSpec(low=low, high=high)
    for by in (None, "fold"):
        df_, total = Counter(), Counter()
        for i, t in enumerate(TEXTS):
            key = (i % 3,) if by else ()
            total.update((g, *key) for g in grams(t, low, high))
            df_.update((g, *key) for g in set(grams(t, low, high)))
        got = T.term_totals(df, spec, by).collect()
        want = {k: (df_[k], total[k]) for k in total}
        assert {(r.term, *((r.fold,) if by else ())): (r.df, r.total) for r in got} == want and len(got) == len(want)


def test_outside_vocabularies_count_the_texts_once(spark):
    rows = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(TEXTS)], "doc_id bigint, fold int, text string")
    spec = T.TfidfSpec(min_df=2, max_df=0.9, max_features=6, low=1, high=2)
    cols = ["term", "df", "total", "idf", "idx"]
    for fold, got in enumerate(T.outside_vocabularies(rows, spec, "fold", range(3))):
        want = T.vocabulary(rows.where(f"fold <> {fold}"), spec)
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
        assert "text" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_task_counts_a_bounded_part_of_the_texts(spark, monkeypatch):
    """The tasks that count terms per document grow with the texts, not their size."""
    monkeypatch.setattr(T, "TASK_BYTES", 200)
    for n in (40, 400):
        df = spark.createDataFrame([(i, "ab cd " * 10) for i in range(n)], "doc_id bigint, text string")
        plan = T.term_counts(df)._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning(doc_id#" in plan and f", {n * 60 // 200}), REPARTITION_BY_NUM" in plan
