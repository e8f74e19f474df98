import pytest
from pyspark.sql import functions as F

from crivo.operators import leakage as L, profile as P

SCHEMA = "doc_id bigint, url string, text string, label int, source string, split string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_dedup_keeps_the_first_by_split_then_key(spark):
    df = frame(spark, [
        (9, "u9", "same  text", 0, "s", "train"), (3, "u3", "same text", 0, "s", "train"),
        (1, "u1", " same text", 0, "s", "dev"), (2, "u2", "same text", 1, "s", "test"), (4, "u4", "other", 1, "s", "test"),
    ])
    for parts in (1, 7):
        d = df.repartition(parts)
        assert sorted(r.doc_id for r in L.exact_dedup(d).collect()) == [3, 4]
        removed = {r.doc_id: r.kept_doc_id for r in L.exact_dedup_removed(d).collect()}
        assert removed == {9: 3, 1: 3, 2: 3}
    once = L.exact_dedup(df)
    assert L.exact_dedup(once).count() == once.count()
    assert L.leakage_guard(once).isEmpty()
    with pytest.raises(AssertionError):
        L.leakage_guard(df, fail=True)


def test_one_text_holds_a_third_of_the_rows(spark):
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"t{i}", 0, "s", "train") for i in range(300)]
    removed = L.exact_dedup_removed(frame(spark, rows)).collect()
    assert len(removed) == 99 and {r.kept_doc_id for r in removed} == {0}


def test_canonical_groups(spark):
    df = frame(spark, [
        (1, "https://pc.gov.br/?p=1", "a", 0, "s", "train"), (2, "https://pc.gov.br/?p=2", "b", 1, "s", "dev"),
        (3, "http://x.com/n", "c", 0, "s", "test"), (4, "http://www.x.com/n/", "d", 0, "s", "test"),
        (5, "http://x.com/n-2", "e", 0, "s", "train"),
    ])
    s = {r["mode"]: r for r in L.canonical_summary(df).collect()}
    assert (s["basic"].groups, s["basic"].cross_split, s["basic"].intra_split, s["basic"].label_conflict) == (2, 1, 1, 1)
    assert (s["aggressive"].groups, s["aggressive"].cross_split) == (2, 2)
    assert sorted(r.doc_id for r in L.canonical_members(df, True).collect()) == [1, 2, 3, 4, 5]
    assert {r.splits: r.groups for r in L.canonical_split_counts(df).collect()} == {"dev+train": 1, "test": 1}


def test_overlap_levels(spark):
    df = frame(spark, [(1, "u", "A b", 0, "s", "train"), (2, "u", "a  b", 0, "s", "test")])
    m = {(r.level, r.split_a, r.split_b): r.common for r in L.leakage_matrix(df).collect()}
    assert [m[(k, "train", "test")] for k in ("url", "raw", "norm", "lower")] == [1, 0, 0, 1]


def test_fingerprint_ignores_order(spark):
    df = frame(spark, [(i, f"u{i}", f"t{i}", i % 2, "s", "train") for i in range(20)])
    mark = lambda d: L.table_fingerprint(d, ["url", "text"]).first().fingerprint
    assert mark(df.repartition(5)) == mark(df.coalesce(1))
    assert mark(df) != mark(df.withColumn("text", F.upper("text")))


def test_source_rules(spark):
    rows = [(i, "u", "t", 1, "short", "train") for i in range(3)]
    rows += [(10 + i, "u", "t", 1, "hot", "train") for i in range(5)]
    rows += [(20 + i, "u", "t", 0, "cold", "train") for i in range(9)] + [(40, "u", "t", 1, "late", "test")]
    df = frame(spark, rows)
    assert [r.source for r in P.shortcut_sources(df).collect()] == ["hot"]
    assert [r.source for r in P.sources_unseen_in_train(df).collect()] == ["late"]
    out = P.outside_top_sources(df).first()
    assert (out.n_outside, out.pos_outside) == (4, 4)
    assert [r.split for r in P.by_split(df, "nonsense").select("split").distinct().orderBy("split").collect()] == ["test", "train"]


def test_histogram_edges(spark):
    sizes = [0, 1, 99, 100, 50118, 50119, 100000]
    df = spark.createDataFrame([(0, "x" * n) for n in sizes], "label int, text string")
    h = P.length_histogram(df).collect()
    assert sum(r.n for r in h) == 2 and all(r.total == 7 for r in h)
    assert {r.bin: r.n for r in h if r.n} == {0: 1, 26: 1}
    toks = spark.createDataFrame([(0, n) for n in (0, 63, 64, 511, 512, 513, 1471, 1472, 9000)], "label int, tokens int")
    t = {r.range: r.n for r in P.token_histogram(toks).collect() if r.n}
    assert t == {"0": 2, "64": 1, "448": 1, "512": 2, "1408": 1, "1472+": 2}
    cut = P.truncation_by_class(toks.withColumn("split", F.lit("train"))).where("split = 'all'").first()
    assert cut.truncated == 4


def test_search_pages(spark):
    df = frame(spark, [(i, f"u{i}", "The Text" if i % 2 else "none", i % 2, "s", "train") for i in range(120)])
    pages = [[r.doc_id for r in P.sample_search(df, p, q="the", split="bogus").collect()] for p in range(4)]
    assert [len(p) for p in pages] == [25, 25, 10, 0] and sum(pages, []) == list(range(1, 120, 2))
    assert [r.doc_id for r in P.search_after(df, ("train", pages[0][-1]), q="the").collect()] == pages[1]
    assert P.search_total(df, q="the", label=1).first().total == 60
