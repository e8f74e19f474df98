"""Linear classifiers on TF-IDF or frozen embeddings with `pyspark.ml`, and batch inference with a user's model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from crivo.functions.text import word_tokens
from crivo.operators.metrics import binary_metrics, ranking_metrics
from crivo.operators.ranking import hash_rank
from crivo.operators.multifit import Setting, fit_many, fold_counts, margins
from crivo.operators.relational import join_groups, with_row
from crivo.operators.sampling import NATURAL, ratio_undersample, stratified_folds
from crivo.operators.stages import SharedPipeline, TfidfEstimator
from crivo.operators.tfidf import CLASSIFIER, TfidfSpec, collect_vocabulary, count_vectors, most_frequent, tfidf_vectors, vocabulary
from crivo.session import materialise

# The grid of the reference experiment.
GRID_C = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
GRID_FEATURES = (1_000, 3_000, 5_000, 10_000)
QUERY_PREFIX = "query: "
ROWS_PER_TASK = 2_000  # the least worth a task in each iteration


@dataclass(frozen=True)
class TextVectorizer:
    """A fitted vocabulary with idf; `transform` adds unit-length `features` without a shuffle."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    spec: TfidfSpec

    def transform(self, df: DataFrame) -> DataFrame:
        counted = count_vectors(df, list(self.terms), list(self.idf), self.spec)
        return Normalizer(p=2.0, inputCol="_w", outputCol="features").transform(counted).drop("_tf", "_w", "text")


def fit_vectorizer(train: DataFrame, spec: TfidfSpec = CLASSIFIER) -> TextVectorizer:
    """The vocabulary is counted on the cluster; max_features bounds what reaches the driver."""
    if spec.sublinear:
        raise ValueError("the classifier takes plain term counts")
    terms, idf = collect_vocabulary(vocabulary(train, spec), spec)
    return TextVectorizer(tuple(terms), tuple(idf), spec)


def embedding_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    raw = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    return Normalizer(p=2.0, inputCol="_v", outputCol="features").transform(raw).drop("_v", column)


def lexicon(train: DataFrame, min_df: int = 5, max_features: int | None = None) -> DataFrame:
    """(term, weight): smoothed log odds of a term's presence in class 1 against class 0, in ten-thousandths.

    Terms of at least `min_df` documents, at most `max_features` of them by document count, ties by term. Counts fold in
    each task; whole-number weights make the sums of `lexicon_scores` the same in any order.
    """
    sizes = train.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    present = train.select("label", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    counts = present.groupBy("term").agg(
        F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0")
    )
    counts = counts.withColumn("total", F.col("c1") + F.col("c0")).where(F.col("total") >= min_df)
    if max_features is not None:
        counts = most_frequent(counts, max_features)
    return with_row(counts, sizes).select("term", _log_odds().alias("weight"))


def _log_odds() -> Column:
    one, other = (F.col("c1") + 1.0) / (F.col("n1") + 2.0), (F.col("c0") + 1.0) / (F.col("n0") + 2.0)
    return F.round(F.log(one / other) * 10000).cast("bigint")


def lexicon_scores(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds `score`, the sum of the weights of the distinct terms of `text`; 0 if none is known."""
    present = df.select("doc_id", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    sums = present.join(weights, "term").groupBy("doc_id").agg((F.sum("weight") / 10000.0).alias("score"))
    rest = df.drop("text", "score")
    return rest.join(sums, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lexicon_grid(train: DataFrame, sets: DataFrame, names: Sequence[str], features: Sequence[int], min_df: int = 5) -> DataFrame:
    """(term, nth_i, weight_i): the lexicons of every training set and feature count, from one pass over the texts.

    Set i is the rows of `train` whose doc_id `sets` (set_name, doc_id) lists under names[i]. The lexicon of its k most frequent
    terms is the rows with nth_i <= k, so only the largest is kept: at most max(features) terms per set.
    """
    of = sets.groupBy("doc_id").agg(F.collect_set("set_name").alias("_sets"))
    rows = train.join(of, "doc_id")
    cell = lambda name, y: F.count_if(F.array_contains("_sets", name) & (F.col("label") == y))
    cells = [cell(n, y).alias(f"{i}_{y}") for i, n in enumerate(names) for y in (1, 0)]
    sizes = materialise(rows.agg(*cells), "lexicon-sizes")
    present = rows.select("_sets", "label", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    counts = materialise(present.groupBy("term").agg(*cells), "lexicon-counts")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "term")  # at most max(features) rows
    entries = []
    for i in range(len(names)):
        mine = counts.select("term", F.col(f"{i}_1").alias("c1"), F.col(f"{i}_0").alias("c0")).withColumn("total", F.col("c1") + F.col("c0"))
        top = most_frequent(mine.where(F.col("total") >= min_df), max(features)).withColumn("nth", F.row_number().over(order))
        top = with_row(top, sizes.select(F.col(f"{i}_1").alias("n1"), F.col(f"{i}_0").alias("n0")))
        entries.append(top.select("term", F.lit(i).alias("i"), "nth", _log_odds().alias("weight")))
    pick = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}_{i}") for i in range(len(names)) for c in ("nth", "weight")]
    return reduce(DataFrame.unionByName, entries).groupBy("term").agg(*pick)


def lexicon_grid_scores(df: DataFrame, grid: DataFrame, names: Sequence[str], features: Sequence[int]) -> DataFrame:
    """Rows of `df` once per set and feature count of a `lexicon_grid`: `config`, `max_features` and the `score` of `lexicon_scores`."""
    grid = F.broadcast(materialise(grid, "lexicon-grid"))  # at most len(names) * max(features) rows
    settings = [(i, k) for i in range(len(names)) for k in features]
    present = df.select("doc_id", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    known = [(F.sum(F.when(F.col(f"nth_{i}") <= k, F.col(f"weight_{i}"))) / 10000.0).alias(f"_{i}_{k}") for i, k in settings]
    sums = present.join(grid, "term").groupBy("doc_id").agg(*known)
    rest = df.drop("text", "score")
    each = [F.struct(F.lit(names[i]).alias("config"), F.lit(k).alias("max_features"), F.coalesce(f"_{i}_{k}", F.lit(0.0)).alias("score")) for i, k in settings]
    return rest.join(sums, "doc_id", "left").select(*rest.columns, F.explode(F.array(*each)).alias("_s")).select(*rest.columns, "_s.*")


def held_out_scores(df: DataFrame, min_df: int = 5) -> DataFrame:
    """Every row scored by the lexicon of all other sources: `score` beside the columns of `df` but the text.

    A source's own counts are subtracted from the totals instead of counting anew without it: one pass over the texts serves
    every source. A row's terms are terms of its source, so the weights needed are those of the (term, source) pairs
    that occur. Rows without a source belong to every lexicon and are not scored.
    """
    one, zero = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    present = df.select("doc_id", "source", "label", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    own = materialise(present.groupBy("term", "source").agg(one.alias("o1"), zero.alias("o0")), "source-terms")
    whole = own.groupBy("term").agg(F.sum("o1").alias("c1"), F.sum("o0").alias("c0"))
    sizes = df.groupBy("source").agg(one.alias("s1"), zero.alias("s0"))
    sizes = with_row(sizes, df.agg(one.alias("n1"), zero.alias("n0")))
    sizes = sizes.join(own.groupBy("source").agg(F.count("*").alias("_terms")), "source")
    left = own.join(whole, "term").select("term", "source", (F.col("c1") - F.col("o1")).alias("c1"), (F.col("c0") - F.col("o0")).alias("c0"))
    left = join_groups(left.where((F.col("c1") + F.col("c0") >= min_df) & F.col("source").isNotNull()), sizes, "source", "_terms", "term")
    positive = (F.col("c1") + 1.0) / (F.col("n1") - F.col("s1") + 2.0)
    negative = (F.col("c0") + 1.0) / (F.col("n0") - F.col("s0") + 2.0)
    weights = left.select("term", "source", F.round(F.log(positive / negative) * 10000).cast("bigint").alias("weight"))
    sums = present.join(weights, ["term", "source"]).groupBy("doc_id").agg((F.sum("weight") / 10000.0).alias("score"))
    rest = df.drop("text", "score").where("source IS NOT NULL")
    return rest.join(sums, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def svm(n: int, c: float = 0.1, max_iter: int = 100, weight: str | None = None) -> LinearSVC:
    """Linear SVM whose penalty matches C on n rows; the margin is the score, its cut is 0."""
    est = LinearSVC(regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=max_iter, labelCol="label")
    return est.setWeightCol(weight) if weight else est


def decision_scores(model, df: DataFrame) -> DataFrame:
    """Adds `score` (margin of class 1) and `pred`."""
    return (
        model.transform(df)
        .withColumn("score", F.get(vector_to_array("rawPrediction"), F.lit(1)))
        .withColumn("pred", F.col("prediction").cast("int"))
        .drop("rawPrediction", "prediction", "probability", "features")
    )


def pack(rows: DataFrame, n: int) -> DataFrame:
    """Fewer, fuller partitions for a small training set: every iteration of a fit starts one task per partition."""
    return rows.coalesce(max(1, -(-n // ROWS_PER_TASK)))


def svm_scores(train: DataFrame, others: DataFrame, spec: TfidfSpec = CLASSIFIER, c: float = 0.1, max_iter: int = 100) -> DataFrame:
    """Fit on `train`, score `others`: (doc_id, url, source, label, split, score, pred)."""
    vec = fit_vectorizer(train, spec)
    features = vec.transform(train).select("label", "features").persist()
    try:
        n = features.count()
        model = svm(n, c, max_iter).fit(pack(features, n))
    finally:
        features.unpersist()
    return decision_scores(model, vec.transform(others))


def top_coefficients(model, vec: TextVectorizer, spark, k: int = 30, flags: DataFrame | None = None) -> DataFrame:
    """The k terms with the largest weight; `flags` (term, source) marks terms that belong to one source."""
    rows = [(t, float(w)) for t, w in zip(vec.terms, model.coefficients.toArray(), strict=True)]
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    df = spark.createDataFrame([(i + 1, t, w) for i, (t, w) in enumerate(top)], "position int, term string, weight double")
    if flags is None:
        return df
    # The k terms take the flags table down to k rows at most before anything is joined to them.
    few = flags.join(F.broadcast(df.select("term")), "term", "left_semi").select("term", F.col("source").alias("source_term_of"))
    return df.join(F.broadcast(few), "term", "left").select(*df.columns, "source_term_of")


def training_sets(train: DataFrame, ratios: Mapping[str, float | None], seed=42) -> DataFrame:
    """(set_name, doc_id) for every ratio."""
    return ratio_undersample(train, ratios, seed).select("set_name", "doc_id")


def one_set(train: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    return train.join(sets.where(F.col("set_name") == name).select("doc_id"), "doc_id", "left_semi")


def ratio_sweep(
    train: DataFrame,
    dev: DataFrame,
    ratios: Mapping[str, float | None],
    spec: TfidfSpec = CLASSIFIER,
    c: float = 0.1,
    seed=42,
    max_iter: int = 100,
) -> DataFrame:
    """One model per training ratio, each scored on dev: (config, doc_id, url, source, label, score, pred)."""
    sets = training_sets(train, ratios, seed)
    out = None
    for name in ratios:
        scored = svm_scores(one_set(train, sets, name), dev, spec, c, max_iter).withColumn("config", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out


def _cores(spark) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def cross_validate(features: DataFrame, cs: Sequence[float], folds: int = 5, seed=42, max_iter: int = 100, parallelism: int | None = None):
    """(best C, its mean F1 over stratified folds, model refitted on all rows); the first C wins a tie."""
    rows = features.join(stratified_folds(features, folds, seed).select("doc_id", "fold"), "doc_id")
    rows = rows.select("label", "features", "fold").persist()
    try:
        n = rows.count()
        est = svm(n, cs[0], max_iter)
        # C holds for the rows that are fitted on: those outside the fold.
        fitted_on = max(n, 1) * (folds - 1) / folds
        grid = ParamGridBuilder().addGrid(est.regParam, [1.0 / (c * fitted_on) for c in cs]).build()
        f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
        cv = CrossValidator(
            estimator=est, estimatorParamMaps=grid, evaluator=f1, numFolds=folds, foldCol="fold",
            parallelism=parallelism or _cores(features.sparkSession),
        ).fit(pack(rows, n))
        best = max(range(len(cs)), key=lambda i: cv.avgMetrics[i])
        model = svm(n, cs[best], max_iter).fit(pack(rows, n))
    finally:
        rows.unpersist()
    return cs[best], cv.avgMetrics[best], model


def ranked_vectors(train: DataFrame, others: DataFrame, spec: TfidfSpec, features: Sequence[int]) -> list[DataFrame]:
    """`train` and `others` with sparse unit vectors (idx, w) in place of their text; idx ranks the terms by frequency.

    Vocabularies are the most frequent terms, so each is the beginning of the next, with the same idf: a text is vectorised
    once for the largest, and a smaller vocabulary is the terms of lower rank.
    """
    spec = replace(spec, max_features=max(features))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "term")  # max_features rows
    terms = materialise(vocabulary(train, spec).withColumn("idx", F.row_number().over(order) - 1), "grid-terms")
    out = []
    for df in (train, others):
        vectors = tfidf_vectors(df, terms, spec, tuple(c for c in df.columns if c != "text")).drop("sig")
        out.append(materialise(vectors, "grid-vectors"))
    return out


def grid_search(
    train: DataFrame,
    dev: DataFrame,
    ratios: Mapping[str, float | None],
    features: Sequence[int] = GRID_FEATURES,
    cs: Sequence[float] = GRID_C,
    folds: int = 5,
    spec: TfidfSpec = CLASSIFIER,
    seed=42,
    max_iter: int = 40,
) -> tuple[DataFrame, DataFrame]:
    """(grid, predictions) over ratio x feature count x C, the C chosen by stratified cross-validation on F1.

    As in the experiment it follows, the vocabulary is fitted once per training set, outside the folds; `grid_search_in_fold`
    fits it inside. The models of a training set, all penalties and folds of a count, are fitted together: see `multifit`.
    """
    spark = train.sparkSession
    sets = materialise(training_sets(train, ratios, seed), "grid-sets")

    def fit(name: str) -> tuple[list, DataFrame]:
        rows, others = ranked_vectors(one_set(train, sets, name), dev, spec, features)
        fold = stratified_folds(rows.select("doc_id", "label"), folds, seed).select("doc_id", "fold")
        rows = rows.join(fold, "doc_id").select("label", "fold", "idx", "w")
        # Every task sends a gradient of its own, so their number follows the cores, not the rows.
        tasks = min(-(-rows.count() // ROWS_PER_TASK), 2 * _cores(spark))
        rows = materialise(rows.coalesce(max(1, tasks)), "grid-rows")
        settings = [Setting(k, c, f) for k in features for c in cs for f in (-1, *range(folds))]
        weights = fit_many(rows, settings, max_iter)
        tp, fp, fn = fold_counts(rows, settings, weights)
        f1 = np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)
        mean = {(k, c): float(np.mean([f1[i] for i, s in enumerate(settings) if (s.features, s.c) == (k, c) and s.fold >= 0])) for k in features for c in cs}
        best = {k: max(cs, key=lambda c, k=k: mean[k, c]) for k in features}  # the first of equal ones
        winners = [Setting(k, best[k]) for k in features]
        columns = weights[:, [settings.index(s) for s in winners]]
        scored = margins(others, winners, columns).withColumn("pred", (F.col("score") >= 0).cast("int"))
        count = F.get(F.lit([int(k) for k in features]).cast("array<int>"), F.col("setting"))
        scored = scored.withColumns({"ratio": F.lit(name), "max_features": count}).drop("setting")
        return [(name, k, float(best[k]), mean[k, best[k]]) for k in features], scored

    fitted = [fit(name) for name in ratios]  # one after the other: the driver holds the weights of one ratio
    preds = reduce(DataFrame.unionByName, [p for _, p in fitted])
    return _grid_table(preds, [c for part, _ in fitted for c in part]), preds


def _grid_table(preds: DataFrame, chosen: list[tuple[str, int, float, float]]) -> DataFrame:
    cv = preds.sparkSession.createDataFrame(chosen, "ratio string, max_features int, best_c double, cv_f1 double")
    m = binary_metrics(preds, 0.0, ["ratio", "max_features"])
    return m.join(F.broadcast(cv), ["ratio", "max_features"]).select(
        "ratio", "max_features", "best_c", F.bround("cv_f1", 4).alias("cv_f1"),
        *[F.bround(x, 4).alias(f"dev_{x}") for x in ("accuracy", "precision", "recall", "f1")],
        "tp", "fp", "fn", "tn",
    )


def bounded_rows(train: DataFrame, most: int, seed=42) -> DataFrame:
    """At most `most` rows, the first of the seeded order within each class, in the classes' shares."""
    ranked = hash_rank(train.select("doc_id", "label"), "doc_id", f"{seed}:rows", by=["label"])
    sizes = train.groupBy("label").agg(F.count("*").alias("_n"))  # a row per class
    total = train.agg(F.count("*").alias("_all"))
    share = F.floor(F.col("_n") * most / F.greatest(F.col("_all"), F.lit(most)))
    few = with_row(ranked.join(F.broadcast(sizes), "label"), total).where(F.col("rank") <= share)
    return train.join(few.select("doc_id"), "doc_id", "left_semi")


def grid_search_in_fold(
    train: DataFrame,
    dev: DataFrame,
    features: Sequence[int] = GRID_FEATURES,
    cs: Sequence[float] = GRID_C,
    folds: int = 5,
    spec: TfidfSpec = CLASSIFIER,
    seed=42,
    max_iter: int = 100,
    most_rows: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(grid, predictions) over feature count x C, with the vocabulary fitted anew inside every fold.

    No term is known from held-out rows. At most `most_rows` labelled rows are fitted on: this is folds x features
    vocabularies where `grid_search` needs one.
    """
    spark = train.sparkSession
    rows = bounded_rows(train, most_rows, seed)
    rows = rows.join(stratified_folds(rows, folds, seed).select("doc_id", "fold"), "doc_id")
    rows = materialise(rows.select("doc_id", "label", "text", "fold"), "in-fold-rows")
    n = rows.count()

    def fit(k: int):
        est = svm(n, cs[0], max_iter)
        pipeline = SharedPipeline(stages=[TfidfEstimator.of(replace(spec, max_features=k)), est])
        fitted_on = max(n, 1) * (folds - 1) / folds
        grid = ParamGridBuilder().addGrid(est.regParam, [1.0 / (c * fitted_on) for c in cs]).build()
        f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
        cv = CrossValidator(
            estimator=pipeline, estimatorParamMaps=grid, evaluator=f1, numFolds=folds, foldCol="fold", parallelism=max(1, _cores(spark) // 2)
        ).fit(rows.drop("doc_id"))
        best = max(range(len(cs)), key=lambda i: cv.avgMetrics[i])
        scored = decision_scores(cv.bestModel, dev).drop("text")
        return cs[best], cv.avgMetrics[best], scored.withColumns({"ratio": F.lit(NATURAL), "max_features": F.lit(k)})

    with ThreadPool(max(1, min(len(features), _cores(spark)))) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(fit), features, chunksize=1)
    preds = reduce(DataFrame.unionByName, [p for *_, p in fitted])
    return _grid_table(preds, [(NATURAL, k, float(c), float(f1)) for k, (c, f1, _) in zip(features, fitted)]), preds


def final_eval(
    train: DataFrame, sets: Mapping[str, DataFrame], spec: TfidfSpec, c: float, max_iter: int = 100, threshold: float = 0.0
) -> DataFrame:
    """Refit the chosen setting once and report every evaluation set at one cut."""
    out = None
    for name, df in sets.items():
        part = df.select("doc_id", "url", "source", "label", "text", F.lit(name).alias("eval_set"))
        out = part if out is None else out.unionByName(part)
    scored = svm_scores(train, out, spec, c, max_iter)
    return binary_metrics(scored, threshold, ["eval_set"]).join(ranking_metrics(scored, ["eval_set"]), "eval_set")


def class_weights(df: DataFrame, ratio_name: str = NATURAL) -> DataFrame:
    """Adds `weight`: negatives per positive for class 1 on the natural ratio, 1 on every other set."""
    if ratio_name != NATURAL:
        return df.withColumn("weight", F.lit(1.0))
    total = df.agg(
        F.try_divide(F.count_if(F.col("label") == 0).cast("double"), F.count_if(F.col("label") == 1)).alias("_pos")
    )
    weight = F.when(F.col("label") == 1, F.coalesce("_pos", F.lit(1.0))).otherwise(1.0)
    return with_row(df, total).withColumn("weight", weight).drop("_pos")


def weighted_logreg(
    train: DataFrame, others: DataFrame, spec: TfidfSpec = CLASSIFIER, ratio_name: str = NATURAL, reg: float = 0.01,
    max_iter: int = 100,
) -> DataFrame:
    """Class-weighted logistic regression; adds the margin, the prediction and the probability of class 1."""
    vec = fit_vectorizer(train, spec)
    rows = class_weights(vec.transform(train), ratio_name).select("label", "features", "weight").persist()
    try:
        est = LogisticRegression(weightCol="weight", regParam=reg, maxIter=max_iter, standardization=False)
        model = est.fit(pack(rows, rows.count()))
    finally:
        rows.unpersist()
    scored = model.transform(vec.transform(others))
    return scored.select(
        *[c for c in others.columns if c != "text"],
        F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"),
        F.col("prediction").cast("int").alias("pred"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("p"),
    )


def embedding_probe(
    train: DataFrame, sets: DataFrame, cs: Sequence[float] = GRID_C, folds: int = 5, seed=42, max_iter: int = 100
) -> DataFrame:
    """Linear probe on frozen vectors: C by cross-validation on train, metrics per split at cut 0."""
    c, f1, model = cross_validate(embedding_features(train), cs, folds, seed, max_iter)
    scored = decision_scores(model, embedding_features(sets))
    return binary_metrics(scored, 0.0, ["split"]).withColumns(
        {"best_c": F.lit(float(c)), "cv_f1": F.lit(round(float(f1), 4))}
    )


def batch_predict(df: DataFrame, make_predict_fn: Callable, inputs: Sequence[Column], return_type, batch_size: int = 64, out: str = "prediction") -> DataFrame:
    """Run a user's model over the rows, `batch_size` at a time; the model is built once per Python worker."""
    predict = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size)
    return df.withColumn(out, predict(*inputs))


def seed_variance(
    train: DataFrame, dev: DataFrame, ratio: float, seeds: Sequence[int], spec: TfidfSpec = CLASSIFIER, c: float = 0.1,
    max_iter: int = 100,
) -> DataFrame:
    """Mean and standard deviation over seeds of the under-sampled fit's dev metrics."""
    out = None
    for s in seeds:
        scored = ratio_sweep(train, dev, {"s": ratio}, spec, c, s, max_iter).withColumn("seed", F.lit(s))
        out = scored if out is None else out.unionByName(scored)
    m = binary_metrics(out, 0.0, ["seed"]).join(ranking_metrics(out, ["seed"]), "seed")
    names = ("ap", "f1", "precision", "recall")
    return m.agg(
        F.count(F.lit(1)).alias("seeds"),
        *[F.bround(F.avg(x), 6).alias(f"mean_{x}") for x in names],
        *[F.bround(F.stddev(x), 6).alias(f"sd_{x}") for x in names],
    )
