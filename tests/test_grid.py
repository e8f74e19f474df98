"""Fits of many models at once, and the vectoriser inside the folds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from crivo.operators import modeling as ML, multifit as MF
from crivo.operators.sampling import stratified_folds
from crivo.operators.stages import SharedPipeline, TfidfEstimator, TfidfModel
from crivo.operators.tfidf import TfidfSpec

SPEC = TfidfSpec(min_df=2, max_df=0.9, max_features=60, low=1, high=1)


def texts(n=90, seed=4):
    rng = np.random.default_rng(seed)
    good, bad = [f"g{i:02d}" for i in range(30)], [f"b{i:02d}" for i in range(30)]
    rows = []
    for i in range(n):
        label = int(i % 4 == 0)
        words = list(rng.choice(good, 8)) + list(rng.choice(bad, 5 if label else 1))
        rows.append((i, " ".join(words), label, f"u{i}", "s"))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(texts(), "doc_id bigint, text string, label int, url string, source string").persist()


def objective(x, y, w, c):
    slack = np.maximum(0, 1 - y * (x @ w))
    return 0.5 * w @ w + c * (slack**2).sum()


def test_columns_reach_the_optimum_of_their_own_problem(spark):
    """Every model, whatever its features, penalty and fold, has a gradient near zero, and no step nearby is better."""
    rng = np.random.default_rng(0)
    n, k = 60, 12
    dense = rng.random((n, k)) * (rng.random((n, k)) < 0.5)
    y, fold = rng.integers(0, 2, n), rng.integers(0, 3, n)
    rows = [(int(y[i]), int(fold[i]), np.flatnonzero(dense[i]).tolist(), dense[i][dense[i] > 0].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, MF.ROWS).repartition(3)
    settings = [MF.Setting(f, c, g) for f in (5, 12) for c in (0.1, 5.0) for g in (-1, 0, 2)]
    weights = MF.fit_many(df, settings, max_iter=200, tolerance=1e-4)
    for j, s in enumerate(settings):
        x = dense[:, : s.features]
        norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
        x = np.hstack([x / np.where(norm > 0, norm, 1), np.ones((n, 1))])
        used = fold != s.fold
        w = np.append(weights[: s.features, j], weights[-1, j])
        assert (weights[s.features : -1, j] == 0).all()
        sign = np.where(y == 1, 1.0, -1.0)
        best = objective(x[used], sign[used], w, s.c)
        slack = np.maximum(0, 1 - sign[used] * (x[used] @ w))
        gradient = w - 2 * s.c * x[used].T @ (sign[used] * slack)
        start = 2 * s.c * np.linalg.norm(x[used].T @ sign[used])
        assert np.linalg.norm(gradient) <= 1e-2 * start
        for step in rng.normal(0, 0.05, (20, len(w))):
            assert objective(x[used], sign[used], w + step, s.c) >= best * (1 - 1e-3)


def test_evaluation_equals_plain_sums():
    rng = np.random.default_rng(2)
    table = pa.table({"label": [1, 0, 1], "fold": [0, 1, 2], "idx": [[0, 2], [], [1, 2, 3]], "w": [[0.6, 0.8], [], [0.1, 0.2, 0.3]]})
    table = table.set_column(2, "idx", table["idx"].cast(pa.list_(pa.int32())))
    settings = [MF.Setting(4, 1.0), MF.Setting(2, 3.0, 2)]
    w, d = rng.normal(size=(5, 2)), rng.normal(size=(5, 2))
    w[2:4, 1] = d[2:4, 1] = 0  # a model has no weight for terms that it does not know
    losses, _ = MF.evaluate(MF.Rows(table, [4, 2]), settings, w, d)
    x = [np.array([[0.6, 0, 0.8, 0], [0, 0, 0, 0], np.array([0, 0.1, 0.2, 0.3]) / np.sqrt(0.14)]), np.array([[1.0, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 0]])]
    y = np.array([1, -1, 1])
    for j, used in enumerate(([0, 1, 2], [0, 1])):
        for i, t in enumerate(MF.STEPS):
            at = w[:, j] + t * d[:, j]
            m = x[j] @ at[:4] + at[4]
            assert np.isclose(losses[i, j], settings[j].c * (np.maximum(0, 1 - y * m)[used] ** 2).sum(), rtol=1e-5)


def test_whole_grid_on_a_small_corpus(spark, corpus):
    train, dev = corpus.where("doc_id < 60"), corpus.where("doc_id >= 60")
    grid, preds = ML.grid_search(train, dev, {"natural": None, "1a2": 2.0}, (10, 60), (0.1, 1.0), 3, SPEC)
    rows = grid.collect()
    assert sorted((r.ratio, r.max_features) for r in rows) == [("1a2", 10), ("1a2", 60), ("natural", 10), ("natural", 60)]
    assert preds.count() == 4 * dev.count() and all(r.best_c in (0.1, 1.0) and 0 <= r.cv_f1 <= 1 for r in rows)
    assert max(r.dev_f1 for r in rows) > 0.6  # calling all positive gives 0.4
    assert all(r.tp + r.fp + r.fn + r.tn == dev.count() for r in rows)


def test_no_term_of_a_fold_is_known_in_it(spark, corpus):
    """Rare words of the held-out rows are in no fold's vocabulary, while a vectoriser fitted once would know them."""
    folds = stratified_folds(corpus).select("doc_id", "fold")
    marked = corpus.join(folds, "doc_id").withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("onlyfold"), "fold")))
    estimator = TfidfEstimator.of(SPEC)
    assert all(f"onlyfold{i}" in estimator.fit(marked).getOrDefault("terms") for i in range(5))
    for i in range(5):
        terms = estimator.fit(marked.where(F.col("fold") != i)).getOrDefault("terms")
        assert f"onlyfold{i}" not in terms and f"onlyfold{(i + 1) % 5}" in terms


def test_stages_can_be_written_and_read(spark, corpus, tmp_path):
    model = Pipeline(stages=[TfidfEstimator.of(SPEC), ML.svm(90, 1.0, 3)]).fit(corpus.select("text", "label"))
    model.write().overwrite().save(f"{tmp_path}/model")
    back = PipelineModel.load(f"{tmp_path}/model")
    assert isinstance(back.stages[0], TfidfModel)
    first, second = (sorted((r.doc_id, r.rawPrediction) for r in m.transform(corpus).collect()) for m in (model, back))
    assert first == second
    estimator = TfidfEstimator.of(SPEC)
    estimator.write().overwrite().save(f"{tmp_path}/estimator")
    assert TfidfEstimator.load(f"{tmp_path}/estimator").spec() == SPEC


def test_shared_pipeline_fits_the_vectoriser_once(spark, corpus, monkeypatch):
    calls = []
    real = TfidfEstimator._fit
    monkeypatch.setattr(TfidfEstimator, "_fit", lambda self, df: calls.append(1) or real(self, df))
    svm = ML.svm(90, 1.0, 3)
    maps = [{svm.regParam: r} for r in (0.01, 0.1, 1.0)]
    models = dict(SharedPipeline(stages=[TfidfEstimator.of(SPEC), svm]).fitMultiple(corpus.select("text", "label"), maps))
    assert sorted(models) == [0, 1, 2] and len(calls) == 1
    assert models[0].stages[1].getRegParam() == 0.01 and models[2].transform(corpus).count() == corpus.count()


def test_in_fold_grid(spark, corpus):
    train, dev = corpus.where("doc_id < 60"), corpus.where("doc_id >= 60")
    grid, preds = ML.grid_search_in_fold(train, dev, (20,), (0.1, 1.0), 3, SPEC, max_iter=5)
    assert grid.count() == 1 and preds.count() == dev.count()
    few = ML.bounded_rows(train, 20)
    assert few.count() <= 20 and {r.label for r in few.collect()} == {0, 1} and ML.bounded_rows(train, 1000).count() == train.count()


def test_every_source_held_out_by_subtraction(spark, corpus):
    """The same scores as a lexicon fitted anew without the source."""
    rows = corpus.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 7))
    got = {r.doc_id: r.score for r in ML.held_out_scores(rows, min_df=3).collect()}
    assert len(got) == rows.count()
    for s in ("s0", "s4"):
        rest, held = rows.where(F.col("source") != s), rows.where(F.col("source") == s)
        for r in ML.lexicon_scores(held, ML.lexicon(rest, min_df=3)).collect():
            assert got[r.doc_id] == pytest.approx(r.score)
    lone = rows.withColumn("source", F.when(F.col("doc_id") > 5, F.col("source")))
    assert ML.held_out_scores(lone, min_df=3).count() == rows.count() - 6


def test_penalty_and_weights_of_the_plain_fits(spark):
    """`svm` minimises the hinge loss whose C is the experiment's, and class weights are the ratio of the classes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=80) > 0).astype(int)
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(int(b), Vectors.dense([float(v) for v in a])) for a, b in zip(x, y)], ["label", "features"])
    c = 0.5
    model = ML.svm(80, c, 200).fit(df.coalesce(1))
    sign = np.where(y == 1, 1.0, -1.0)

    def hinge(w, b):
        return 0.5 * w @ w + c * np.maximum(0, 1 - sign * (x @ w + b)).sum()

    w, b = model.coefficients.toArray(), model.intercept
    best = hinge(w, b)
    assert all(hinge(w + d[:3], b + d[3]) >= best * (1 - 2e-3) for d in rng.normal(0, 0.05, (50, 4)))
    rows = spark.createDataFrame([(i, int(i < 5)) for i in range(25)], "doc_id bigint, label int")
    assert {(r.label, r.weight) for r in ML.class_weights(rows).collect()} == {(1, 4.0), (0, 1.0)}
    assert {r.weight for r in ML.class_weights(rows, "1a2").collect()} == {1.0}


def test_gradients_come_back_once_in_blocks(spark, monkeypatch):
    """Models of one feature count are fitted side by side, within bounds, and the driver gets each sum once."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        idx = sorted(int(t) for t in rng.choice(12, 4, replace=False))
        rows.append((int(rng.random() < 0.4), i % 3, idx, [0.5] * 4))
    df = spark.createDataFrame(rows, MF.ROWS).repartition(5)
    settings = [MF.Setting(k, c, f) for k in (5, 12) for c in (0.5, 2.0) for f in (-1, 0, 1)]
    weights, direction = rng.normal(size=(13, len(settings))).astype(np.float32), rng.normal(size=(13, len(settings))).astype(np.float32)
    table = df.toArrow()
    losses, gradient = MF.evaluate(MF.Rows(table, [s.features for s in settings]), settings, weights, direction)
    whole = MF.fit_many(df, settings, 15)
    monkeypatch.setattr(MF, "SENT", 50)
    monkeypatch.setattr(MF, "MOST_WEIGHTS", 30)
    got = MF._sum(df, settings, weights, direction)
    assert np.allclose(got[0], losses, rtol=1e-4) and np.allclose(got[1], gradient, rtol=1e-3, atol=1e-3)
    sizes, fit = [], MF._fit
    monkeypatch.setattr(MF, "_fit", lambda d, some, *a: sizes.append((len(some), {s.features for s in some})) or fit(d, some, *a))
    assert np.allclose(MF.fit_many(df, settings, 15), whole, atol=2e-2)
    assert [n for n, _ in sizes] == [5, 1, 2, 2, 2] and all(len(k) == 1 for _, k in sizes)
