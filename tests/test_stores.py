"""Versions, indexes, hash trees, kept counts, masks and buckets: what they save, and that results stay the same."""

import re

import pytest
from pyspark.sql import functions as F

from crivo.functions import text as X
from crivo.functions.tokens import tokenizer_count, word_token_count
from crivo.operators import hashtree as H, leakage as L
from crivo.operators.masking import Masker, mask_by_terms
from crivo.operators.textindex import TrigramIndex
from crivo.plans import store_queries as Q
from crivo.session import publish
from crivo.sources import views as V
from crivo.sources.tokencache import TokenCounts
from crivo.sources.versions import VersionConflict, VersionedTable

ROOT = "/root/testdata/sf0.001"


def test_publish_takes_a_name_once(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    assert publish(spark, f"{tmp_path}/a", f"{tmp_path}/x/final") and not publish(spark, f"{tmp_path}/b", f"{tmp_path}/x/final")
    assert spark.read.parquet(f"{tmp_path}/x/final").count() == 3 and spark.read.parquet(f"{tmp_path}/b").count() == 3


def test_rewrite_copies_only_files_that_change(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    rows = spark.range(0, 1000, 1, 10).withColumn("text", F.concat(F.lit("t"), "id"))
    assert table.create(rows) == 0 and len(table.files()) == 10
    hit = F.col("id") == 250
    change = lambda df: df.withColumn("text", F.when(hit, "new").otherwise(F.col("text")))
    assert table.rewrite(hit & (F.col("text") != "new"), change) == 1
    old, new = set(table.files(0)), set(table.files(1))
    assert len(old - new) == 1 and len(old & new) == 9
    assert table.read().count() == 1000 and table.read().where(hit).first().text == "new" and table.read(0).where(hit).first().text == "t250"
    assert table.rewrite(hit & (F.col("text") != "new"), change) is None and table.versions() == [0, 1]
    with pytest.raises(VersionConflict):
        table._publish(1, [])


def test_footer_rewrite_changes_some_files_and_repeats_nothing(spark):
    table = Q.footer_rewritten(spark, ROOT, Q.LICENCE)
    assert table.versions() == [0, 1]
    before, after = table.read(0), table.read(1)
    assert before.join(after.select("doc_id", F.col("text").alias("now")), "doc_id").where("text <> now").count() > 0


def test_indexed_search_equals_a_scan_and_reads_less(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["A needle here", "no such", "NEEDLE", "nee dle", "x\nneedle\ny", "", None, "né e", "ab", "😀needle😀", "…" * 50])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = TrigramIndex(spark, f"{tmp_path}/small").build(df)
    for needle in ("needle", " NeeDle ", "\nn", "x\nn", "😀n", "e😀", "zzz", "ab", "", "né e", "……", "e"):
        folded = needle.strip().lower()
        want = sorted(i for i, t in rows if (t is not None or not folded) and folded in (t or "").lower())
        assert sorted(r.doc_id for r in index.search(df, needle).collect()) == want, needle
    corpus = V.corpus_all(spark, ROOT)
    whole = TrigramIndex(spark, f"{tmp_path}/whole").build(corpus)
    text = next(r.text for r in corpus.orderBy("doc_id").collect() if len(r.text) > 300)
    needle = text[200:230]
    among = whole.candidates(needle).count()
    hits = corpus.where(X.contains_folded(F.col("text"), needle.strip())).count()
    assert 1 <= hits <= among < corpus.count() / 4
    assert whole.search(corpus, needle).count() == hits


def test_index_lists_trigrams_per_group_of_documents(spark, tmp_path, monkeypatch):
    """Neighbouring documents share a row of a list, and groups of any size give the true rows, null and repeated keys too."""
    import crivo.operators.textindex as T

    df = spark.range(400).selectExpr("id AS doc_id", "concat('common words ', if(id % 100 = 7, 'Odd😀one', 'x')) AS text").coalesce(1)
    index = T.TrigramIndex(spark, f"{tmp_path}/same").build(df)
    lists = spark.read.parquet(f"{tmp_path}/same/lists")
    assert lists.count() < 100 and lists.agg(F.sum("n")).first()[0] == 396 * 12 + 4 * 18
    assert sorted(r.doc_id for r in index.search(df, "odd😀ONE").collect()) == [7, 107, 207, 307]
    texts = ["abc", "ab", "", None, "cab abc", "b", "c", "zabcz", "aaaa", "😀😀😀"]
    got = {}
    for first, row, start, grams in (g for size in (1, 4, 1000) for g in T._distinct_trigrams([t or "" for t in texts][:size])):
        for gram, a, b in zip(grams, start, [*start[1:], len(row)]):
            got.setdefault(gram, set()).update((row[a:b] + first).tolist())
    assert got == {g: {i for i, t in enumerate(texts) if g in (t or "")} for g in got} and len(got) == 9
    monkeypatch.setattr(T, "CHARACTERS", 5)
    assert sorted(int(r) + first for first, row, _, _ in T._distinct_trigrams(["abc"] * 9) for r in row) == list(range(9))


def test_tree_reads_only_buckets_that_differ(spark, tmp_path):
    rows = [(f"u{i}", f"text {i}", i % 2) for i in range(500)] + [(None, "lone", 1), ("", "lone", 0)]
    schema = "url string, text string, label int"
    old = spark.createDataFrame(rows, schema)
    new = spark.createDataFrame([r for r in rows if r[0] != "u7"] + [("u500", "x", 1)], schema)
    new = new.withColumn("text", F.when(F.col("url") == "u9", "changed").when(F.col("url") == "u11", "text  11").otherwise(F.col("text")))
    paths = [H.write_hashed(v, f"{tmp_path}/{n}", ["text", "label"]) for v, n in ((old, "old"), (new, "new"))]
    want = L.reconcile_versions(old, new, ["text", "label"]).first()
    assert H.reconcile_by_tree(spark, *paths, ["text", "label"]).first() == want and want.matched == 499
    trees = [spark.read.parquet(f"{p}/tree") for p in paths]
    found = H.differing(*trees)
    assert 1 <= len(found) <= 4
    plan = spark.read.parquet(f"{paths[0]}/rows").where(F.col("_bucket").isin([f"h{b}" for b in found]))
    assert len({f.rpartition("_bucket=")[2].partition("/")[0] for f in plan.inputFiles()}) >= len(found)  # listed
    assert "PartitionFilters: [_bucket" in plan._jdf.queryExecution().executedPlan().toString()
    assert H.differing(trees[0], trees[0]) == []
    same = H.reconcile_by_tree(spark, paths[0], paths[0], ["text", "label"]).first()
    assert same == L.reconcile_versions(old, old, ["text", "label"]).first()


def test_second_run_counts_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a bc de"), (2, "a bc de"), (3, None), (4, ""), (5, "xyz")], "doc_id bigint, text string")
    cache = TokenCounts(spark, str(tmp_path), "words")
    assert cache.update(df.where("doc_id < 3"), word_token_count) == 1
    assert cache.update(df, word_token_count) == 2 and cache.update(df, word_token_count) == 0
    assert {r.doc_id: r.tokens for r in cache.counts(df).collect()} == {1: 4, 2: 4, 3: 2, 4: 2, 5: 3}
    other = TokenCounts(spark, str(tmp_path), "letters")
    assert other.update(df, tokenizer_count(lambda ts: [list(t) for t in ts])) == 3


def test_masking_by_many_terms_equals_one_alternation(spark):
    terms = ["the", "ing", "red house", "red", "house of", "é", "a-b", "x1"]
    texts = ["The red house of Red", "nothing, the-end. THE", "a-b a b A-B c", "É éa x1x X1", "", "red  house", "houses of house of"]
    body = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    want = [re.sub(rf"(?i)(?<!\w)(?:{body})(?!\w)", " ", t) for t in texts]
    assert [Masker(terms)(t) for t in texts] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id bigint, text string")
    listed = spark.createDataFrame([(t,) for t in [*terms, "the", None]], "term string")
    got = [r.text for r in mask_by_terms(df, listed).orderBy("doc_id").collect()]
    assert got == [*want, None]
    with pytest.raises(ValueError):
        mask_by_terms(df, listed, most_terms=3)


def test_bucketed_join_has_no_exchange(spark):
    plan = Q.bucketed_prediction_join(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
