import numpy as np
import pytest
from pyspark.sql import functions as F

from crivo.operators import metrics as M, selection as SE


def preds(spark, labels, scores):
    rows = [(i, int(y), float(s), "dev") for i, (y, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "doc_id bigint, label int, score double, eval_set string")


def test_golden_cells(spark):
    cells = spark.createDataFrame([(46, 19, 35, 8991), (48, 7, 126, 11129)], "tp bigint, fp bigint, fn bigint, tn bigint")
    got = [tuple(round(r[c], 4) for c in ("accuracy", "precision", "recall", "f1")) for r in M.rates(cells).orderBy("tp").collect()]
    assert got == [(0.9941, 0.7077, 0.5679, 0.6301), (0.9882, 0.8727, 0.2759, 0.4192)]


def test_degenerate(spark):
    for labels, scores in (([0, 1], [-1, -1]), ([0, 0], [1, -1])):
        r = M.binary_metrics(preds(spark, labels, scores)).first()
        assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_ap_and_roc_with_ties(spark):
    p = preds(spark, [1, 0, 1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6, 0.5, 0.5])
    assert M.average_precision(p).first().ap == pytest.approx(0.722222, abs=1e-6)
    assert M.roc_auc(p).first().roc_auc == pytest.approx(0.611111, abs=1e-6)
    perfect = preds(spark, [1, 1, 0], [3, 2, 1])
    assert M.average_precision(perfect).first().ap == 1.0
    lifted = p.withColumn("score", F.exp("score"))
    assert M.roc_auc(lifted).first() == M.roc_auc(p).first()


def test_threshold_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for n in (3, 50, 333):
        y = rng.integers(0, 2, n)
        s = np.round(rng.normal(size=n) + y, 1)  # many ties
        cand = {r.k: r for r in M.threshold_candidates(preds(spark, y, s)).collect()}
        assert sorted(cand) == list(range(1000))
        best, best_f1 = None, -1.0
        for k, t in enumerate(np.percentile(s, np.linspace(0.1, 99.9, 1000))):
            hit = s >= t
            tp = int((hit & (y == 1)).sum())
            f1 = 2 * tp / (hit.sum() + y.sum()) if hit.sum() + y.sum() else 0.0
            assert cand[k].threshold == pytest.approx(t, abs=1e-9)
            if abs(cand[k].threshold - t) == 0:
                assert (cand[k].tp, cand[k].fp) == (tp, int(hit.sum()) - tp)
            if f1 > best_f1 + 1e-12:
                best, best_f1 = t, f1
        got = M.best_threshold(preds(spark, y, s)).first()
        assert got.f1 == pytest.approx(best_f1, abs=1e-6) and got.threshold == pytest.approx(best, abs=1e-6)


def test_bootstrap_covers_the_estimate(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 120)
    p = preds(spark, y, rng.normal(size=120) + y)
    point = M.binary_metrics(p, 0.5).first()
    for with_ap in (False, True):
        ci = {r.metric: r for r in M.bootstrap_ci(p, 0.5, 200, with_ap=with_ap).collect()}
        assert ci["f1"].low < point.f1 < ci["f1"].high and ci["f1"].replicates == 200
    one_class = preds(spark, [1, 0], [1.0, -1.0])
    kept = M.bootstrap_ci(one_class, 0.0, 100, skip_degenerate=False).first().replicates
    assert kept == 100 > M.bootstrap_ci(one_class, 0.0, 100).first().replicates


def test_running_totals_do_not_depend_on_buckets(spark):
    from crivo.operators.ranking import running_points, score_points

    p = preds(spark, [i % 3 == 0 for i in range(200)], [i % 37 for i in range(200)])
    runs = [sorted(map(tuple, running_points(score_points(p), buckets=b).collect())) for b in (2, 64)]
    assert runs[0] == runs[1] and len(runs[0]) == 37


def test_grid_winner_of_the_published_grid(spark):
    f1 = {
        "1a10": (0.4574, 0.5, 0.5028, 0.5476), "1a64": (0.4944, 0.4946, 0.4681, 0.5905),
        "natural": (0.3951, 0.4138, 0.4471, 0.5306),
    }
    rows = [(r, k, v) for r, vs in f1.items() for k, v in zip((1000, 3000, 5000, 10000), vs, strict=True)]
    w = SE.grid_winner(spark.createDataFrame(rows, "ratio string, max_features int, dev_f1 double")).collect()
    assert {r.max_features for r in w} == {10000} and [r.ratio for r in w if r.winner] == ["1a64"]


def test_prediction_join_checks(spark):
    corpus = spark.createDataFrame([("u1", "s", "dev")], "url string, source string, split string")
    p = spark.createDataFrame([("u1", 0.5), ("gone", 0.1)], "url string, score double")
    assert SE.prediction_join(p, corpus).count() == 1
    with pytest.raises(ValueError):
        SE.prediction_join(p, corpus, check=True)


def test_draws_have_the_moments_of_a_multinomial(spark):
    """Means, variances and covariances of counts drawn down the tree, for small and for large numbers of rows."""
    for weights in ([3, 0, 5, 1, 1], [4000, 3, 2500, 0, 1200, 9000, 1]):
        n, reps = sum(weights), 3000
        cells = spark.createDataFrame(list(enumerate(weights)), "cell bigint, weight bigint")
        rows = M.multinomial_draws(cells, reps, seed=1).collect()
        x = np.zeros((reps, len(weights)))
        for r in rows:
            x[r.replicate - 1, r.cell] = r.n
        p = np.array(weights) / n
        assert (x.sum(axis=1) == n).all() and (x[:, p == 0] == 0).all()
        sd = np.sqrt(n * p * (1 - p))
        assert (np.abs(x.mean(axis=0) - n * p) <= 5 * sd / np.sqrt(reps) + 0.02).all()
        cov = n * (np.diag(p) - np.outer(p, p))
        assert (np.abs(np.cov(x.T) - cov) <= 0.12 * np.outer(sd, sd) + 0.03).all()


def test_draws_do_not_grow_with_the_rows(spark):
    """Work is cells times replicates: a table of 10 and one of 10**12 rows give as many counts."""
    for scale in (1, 10**11):
        cells = spark.createDataFrame([(0, 3 * scale), (1, 2 * scale), (2, 5 * scale)], "cell bigint, weight bigint")
        assert M.multinomial_draws(cells, 50).count() <= 3 * 50
    plan = M.bootstrap_ci(preds(spark, [1, 0, 1], [1.0, 0.5, 0.2]), 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1, 2000" not in plan


def test_row_draws_draw_every_row_of_every_replicate(spark):
    """The draws by key against md5 row by row; the registered query draws so, and not counts of four cells."""
    import hashlib

    from crivo.plans.model_queries import bootstrap_ci
    from crivo.plans.registry import ORACLE

    y, s = [1, 0, 1, 0, 0, 1, 0], [1.0, 0.5, -0.2, -1.0, 0.1, 0.3, -0.4]
    keys = [5, 9, 12, 12, 40, 41, None]
    df = spark.createDataFrame(list(zip(keys, y, s)), "doc_id bigint, label int, score double")
    tp, fn, fp, n = 2, 1, 2, 7
    want = []
    for rep in range(1, 31):
        at = [int(hashlib.md5(":".join(["42", str(rep)] + ([] if k is None else [str(k)])).encode()).hexdigest()[:15], 16) % n for k in keys]
        want.append((rep, sum(i < tp for i in at), sum(tp + fn <= i < tp + fn + fp for i in at), sum(tp <= i < tp + fn for i in at), sum(i >= tp + fn + fp for i in at)))
    got = M.row_draws(df, 0.0, "doc_id", 30).select("replicate", "tp", "fp", "fn", "tn").collect()
    assert sorted(map(tuple, got)) == want and all(sum(r[1:]) == n for r in want)
    assert "md5('42:'||rep||':'||doc_id)" in ORACLE["bootstrap_ci"] and 'key="doc_id"' in __import__("inspect").getsource(bootstrap_ci)


def test_ap_of_replicates_from_one_row_per_drawn_score(spark, monkeypatch):
    """Both counts of a score are drawn as one row, and blocks of places of any size add up to the plain average precision."""
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    df = preds(spark, y, s)
    scores = sorted(set(s.tolist()), reverse=True)
    cells = [(2 * i + (1 - v), int(((s == x) & (y == v)).sum())) for i, x in enumerate(scores) for v in (1, 0)]
    weights = spark.createDataFrame(cells, "cell bigint, weight bigint")
    drawn = {}
    for r in M.multinomial_draws(weights, 20).collect():
        drawn.setdefault(r.replicate, {})[r.cell] = r.n
    paired = M.paired_draws(weights, 20).collect()
    assert {(r.replicate, r.node): (r.left, r.n - r.left) for r in paired} == {
        (k, c // 2): (d.get(c // 2 * 2, 0), d.get(c // 2 * 2 + 1, 0)) for k, d in drawn.items() for c in d
    }
    want = {}
    for k, d in drawn.items():
        tp = fp = ap = 0
        for i in range(len(scores)):
            pos = d.get(2 * i, 0)
            tp, fp = tp + pos, fp + d.get(2 * i + 1, 0)
            ap += pos * tp / max(tp + fp, 1)
        want[k] = (sum(d.get(2 * i, 0) for i, x in enumerate(scores) if x >= 0.2), ap / tp)
    for bits in (1, 3, 10):
        monkeypatch.setattr(M, "PLACE_BITS", bits)
        got = {r.replicate: (r.tp, r.ap) for r in M.bootstrap_replicates(df, 0.2, 20, with_ap=True).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_grid_of_lexicons_from_one_pass_equals_single_ones(spark):
    """Every training set and feature count as fitted alone; repeated rows, a null key and null texts among them."""
    from crivo.operators import modeling as ML

    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 2)), " ".join(f"w{int(t)}" for t in rng.integers(0, 25, 12))) for i in range(80)]
    rows += [rows[3], (None, 1, "w1 w2"), (90, 0, None), (91, None, "w3 w4")]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, text string")
    train, dev = df.where("doc_id % 4 <> 0"), df.where("doc_id % 4 = 0 OR doc_id IS NULL OR doc_id = 90")
    sets = train.selectExpr("'all' AS set_name", "doc_id").unionByName(train.where("doc_id % 3 = 0").selectExpr("'third' AS set_name", "doc_id"))
    names, sizes = ["all", "third", "none"], (3, 10, 100)
    grid = ML.lexicon_grid(train, sets, names, sizes)
    got = {}
    for r in ML.lexicon_grid_scores(dev, grid, names, sizes).collect():
        got.setdefault((r.config, r.max_features), []).append((str(r.doc_id), r.label, r.score))
    for name in names:
        for k in sizes:
            alone = ML.lexicon_scores(dev, ML.lexicon(ML.one_set(train, sets, name), max_features=k))
            assert sorted(got[name, k]) == sorted((str(r.doc_id), r.label, r.score) for r in alone.collect())
