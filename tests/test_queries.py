"""Registered queries: contract, plan shape, and a few against the same question in SQL."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check
from crivo.operators import neardup

ROOT = "/root/testdata/sf0.001"
QUICK = ("split_overlap", "exact_dedup", "overview", "length_histogram", "canonical_url_summary", "exposure_sets", "best_threshold", "bootstrap_ci_ap", "near_dup_pairs")
RELATIONAL = (
    "exact_dedup", "leakage_matrix", "source_by_split", "ratio_undersample", "average_precision", "best_threshold", "bootstrap_ci",
    "truncation_by_class", "tfidf_vocab", "integrity_audit", "reconcile_versions", "capped_positive_sample", "length_stats", "token_stats",
)
THRESHOLDED = ("near_dup_pairs", "near_dup_filter", "similarity_histogram")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", RELATIONAL)
def test_plan_is_distributed(spark, name):
    plan = entry.queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapIn" not in plan


@pytest.mark.parametrize("name", THRESHOLDED)
def test_thresholded_matches_take_no_grid(spark, name, monkeypatch):
    monkeypatch.setattr(neardup, "best_matches", None)
    assert entry.queries()[name](spark, ROOT).count() > 0


def test_workers_need_no_path(tmp_path):
    """Python kernels reach the workers of a session that starts elsewhere, without PYTHONPATH."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from crivo.session import local_session\n"
        f"s = local_session(2, spark__ui__showConsoleProgress='false')\n"
        f"q = e.queries(); print('ROWS', q['near_dup_pairs'](s, {ROOT!r}).count(), q['embedding_top1'](s, {ROOT!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = out.stdout.rpartition("ROWS ")[2].split()
    assert len(rows) == 2 and all(int(n) > 0 for n in rows), out.stderr[-2000:]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got = entry.queries()[name](spark, ROOT).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canon(got) == check.canon(want)
