import os
import struct

import corpus_pipeline
from crivo.llm import exactdedup, neardup, quality
from crivo.llm.queries import tokenizer_file
from crivo.plans.registry import ORACLE, QUERIES

from . import edge
from .test_neardup import brute as near_brute
from .test_mixing import edf  # noqa: F401  the schedule's own test

ROOT = "/root/testdata/sf0.001"


def test_stages_and_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    judged = {r["row"]["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    good = [r for r in rows if judged[r[0]]]
    stage = corpus_pipeline.quality_stage(spark, docs, ROOT)
    assert sorted(tuple(r) for r in stage.collect()) == sorted(good) and stage.columns == docs.columns

    first: dict = {}
    for r in sorted(good, key=lambda r: (-len(r[1]), r[0])):
        first.setdefault("".join(r[1].split()), r)
    unique = sorted(first.values())
    groups = near_brute([(r[0], r[1]) for r in unique], 80)
    kept = {doc_id for doc_id, _, _, stays in groups if stays}
    left = [r for r in unique if r[0] in kept]
    pieces = corpus_pipeline.run(spark, ROOT).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids.setdefault(p["doc_id"], []).extend(struct.unpack(f"<{p['length']}I", p["ids"]))
    assert set(ids) == kept == {r[0] for r in left}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    texts = {r[0]: r[1] for r in rows}
    assert all(v == tokenizer.encode(texts[i], add_special_tokens=False).ids + [1] for i, v in ids.items())


def test_registered():
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    numbers = [n for n in QUERIES if n.startswith("op")]
    assert [n.split("_")[0] for n in numbers] == [f"op{i}" for i in range(1, 14)] and "pipeline" in QUERIES
    assert {"op4_token_counts", "op8_exact_dedup"} <= set(ORACLE)


def test_nothing_else_needs_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{root}/crivo"):
        for name in names:
            if name.endswith(".py") and "/llm" not in folder:
                assert "crivo.llm" not in open(f"{folder}/{name}").read(), name
    assert exactdedup and neardup


def test_stages_survive_edge_rows_and_an_empty_table(spark, tmp_path):
    for rows, name in ((edge.docs(spark), "some"), (edge.empty(spark), "none")):
        path = f"{tmp_path}/{name}"
        rows.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns, stage_name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert corpus_pipeline.run(spark, path).count() >= 0
