from collections import defaultdict

import pytest

from crivo.llm import mixing

from . import edge


def edf(blocks):
    """Earliest deadline first, slot by slot."""
    m, done, out = sum(blocks.values()), dict.fromkeys(blocks, 0), []
    for t in range(m):
        ready = [s for s, b in blocks.items() if done[s] < b and done[s] * m // b <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * m // blocks[s]), s))
        out.append((s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("blocks", [{"a": 1}, {"a": 7, "b": 1, "c": 13}, {f"s{i}": 1 + i * i % 11 for i in range(20)}])
def test_schedule_is_edf_and_stays_within_a_block(spark, blocks):
    got = mixing.schedule(spark.createDataFrame(list(blocks.items()), "source string, n_blocks long")).orderBy("slot").collect()
    assert [(r["source"], r["block"]) for r in got] == edf(blocks)
    m, done = len(got), defaultdict(int)
    for t, r in enumerate(got):
        assert r["release"] <= t < r["deadline"]
        done[r["source"]] += 1
        for s, b in blocks.items():
            assert abs(done[s] - (t + 1) * b / m) < 1


def test_rows_and_shares(spark):
    rows = [edge.row(i, f"t{i}", source="hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    out = mixing.mix(edge.docs(spark, rows), max_blocks=40, bucket_rows=50).collect()
    n = defaultdict(int)
    for r in rows:
        n[r[3]] += 1
    taken, places = defaultdict(list), set()
    for r in out:
        taken[r["source"]].append(r["doc_id"])
        places.add((r["_slot"], r["_place"]))
    assert {s: len(x) for s, x in taken.items()} == {s: min(k, 150) for s, k in n.items()}
    assert len(places) == len(out) and all(len(set(x)) == len(x) for x in taken.values())


def test_given_weights(spark):
    rows = [edge.row(i, "t", source="ab"[i % 2]) for i in range(100)]
    out = mixing.mix(edge.docs(spark, rows), {"a": 3, "b": 1, "none": 5})
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"a": 50, "b": 16}


def test_edges(spark):
    out = mixing.mix(edge.docs(spark), max_share=1.0)
    assert out.drop("_block", "_release", "_deadline", "_slot", "_place").columns == edge.docs(spark).columns
    assert out.count() == len(edge.ROWS)
    again = mixing.mix(out, max_share=1.0)
    assert again.columns == out.columns and again.count() == out.count()
    assert mixing.mix(edge.empty(spark)).count() == 0


def test_excess_follows_the_mixture(spark):
    rows = [edge.row(i, f"t{i}", source="hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    docs = edge.docs(spark, rows)
    first = {r["doc_id"]: r for r in mixing.mix(docs, max_blocks=40, bucket_rows=50).collect()}
    out = mixing.mix(docs, max_blocks=40, bucket_rows=50, excess=True).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(600)) and len({(r["_slot"], r["_place"]) for r in out}) == 600
    last = max(r["_slot"] for r in first.values())
    assert all(first[r["doc_id"]] == r if r["doc_id"] in first else r["_slot"] > last and r["source"] == "hot" for r in out)
    assert all(r["_release"] <= r["_slot"] < r["_deadline"] for r in out)
    assert {r["_slot"] for r in out} == set(range(max(r["_slot"] for r in out) + 1))
    assert len({(r["source"], r["_block"], r["_place"]) for r in out}) == 600
    assert mixing.mix(docs, {"s0": 1}, excess=True).count() == 600 and mixing.mix(edge.empty(spark), excess=True).count() == 0


def test_registered_stages_keep_a_hot_source(spark, tmp_path):
    import corpus_pipeline
    from crivo.plans.registry import QUERIES

    docs = edge.docs(spark, [edge.row(i, f"t{i}", source="hot" if i % 3 else "s") for i in range(60)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op9_mixing"](spark, str(tmp_path)).count() == 60
    assert corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).count() == 60


def test_sql_agrees_on_a_hot_source(spark, tmp_path):
    from .test_quality import same_as_sql

    rows = [edge.row(i, f"t{i}", source="hot" if i % 3 else f"s{i % 7}") for i in range(5000)]
    same_as_sql(spark, "op9_mixing", tmp_path, rows, edge.SCHEMA)
