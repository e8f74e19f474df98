from crivo.operators.tfidf import TfidfSpec
from crivo.plans import jobs
from crivo.plans.audit_queries import DOMINANT
from crivo.sources import views as V

ROOT = "/root/testdata/sf0.01"


def test_audit_writes_every_table(spark, tmp_path):
    df = V.corpus(spark, "/root/testdata/sf0.001")
    tables = jobs.audit(df)
    paths = jobs.write_reports({k: tables[k] for k in ("source_by_split", "near_dup_pairs", "shortest_texts")}, str(tmp_path))
    back = spark.read.csv(paths["source_by_split"], header=True)
    assert back.count() == tables["source_by_split"].count()


def test_domain_shift_experiment(spark):
    spec = TfidfSpec(min_df=2, max_df=0.9, max_features=300, low=1, high=1)
    out = jobs.domain_shift_experiment(
        V.corpus(spark, ROOT), DOMINANT, {"natural": None, "1a2": 2.0}, {"natural": (1, None), "1a2": (2, 2.0)}, spec,
        max_iter=5, check_similarity=False,
    )
    row = out["domain_shift"].first()
    assert 0 <= row.exp_ap <= 1 and 0 <= row.in_f1 <= 1 and row.exp_best_f1 >= row.exp_f1 - 1e-9
    assert out["dev_ranking"].where("winner = 1").count() == 1
    assert {r.metric for r in out["ci_test"].collect()} == {"f1", "recall", "precision", "ap"}


def test_grid_search_query_asks_for_the_whole_grid(monkeypatch):
    """The registered query's settings; tests/test_grid.py runs a real, smaller grid."""
    from crivo.plans import model_queries as Q

    asked = {}

    def search(train, dev, ratios, features=Q.ML.GRID_FEATURES, cs=Q.ML.GRID_C, folds=5, **_):
        asked.update(ratios=set(ratios), features=tuple(features), cs=tuple(cs), folds=folds)
        return None, None

    monkeypatch.setattr(Q.ML, "grid_search", search)
    monkeypatch.setattr(Q, "_splits", lambda spark, sf: (None, None, None))
    monkeypatch.setattr(Q.SE, "grid_winner", lambda grid: grid)
    Q.grid_search(None, "")
    assert asked == {"ratios": set(Q.RATIOS), "features": Q.ML.GRID_FEATURES, "cs": Q.ML.GRID_C, "folds": 5}
