"""Stages for `pyspark.ml` pipelines: a TF-IDF vectoriser that is fitted with the model, and a pipeline that shares it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from threading import Lock

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from crivo.operators.tfidf import TfidfSpec, collect_vocabulary, count_vectors, vocabulary


class _TfidfParams(HasInputCol, HasOutputCol):
    minDF = Param(Params._dummy(), "minDF", "least documents of a term", TypeConverters.toInt)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of the documents", TypeConverters.toFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most frequent terms to keep; bounds what reaches the driver", TypeConverters.toInt)
    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)

    def spec(self) -> TfidfSpec:
        get = self.getOrDefault
        return TfidfSpec(get(self.minDF), get(self.maxDF), get(self.maxFeatures), False, get(self.low), get(self.high))


class TfidfEstimator(Estimator, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a vocabulary with idf to the texts it is given: inside a cross-validation, to the training folds only."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="features", minDF=2, maxDF=0.9, maxFeatures=20_000, low=1, high=3):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="features", minDF=2, maxDF=0.9, maxFeatures=20_000, low=1, high=3)
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, spec: TfidfSpec) -> TfidfEstimator:
        if spec.sublinear or spec.max_features is None:
            raise ValueError("the classifier takes plain term counts and a bounded vocabulary")
        return cls(minDF=spec.min_df, maxDF=spec.max_df, maxFeatures=spec.max_features, low=spec.low, high=spec.high)

    def _fit(self, dataset: DataFrame) -> TfidfModel:
        texts = dataset.select(dataset[self.getInputCol()].alias("text"))
        terms, idf = collect_vocabulary(vocabulary(texts, self.spec()), self.spec())
        return self._copyValues(TfidfModel(terms, idf))


class TfidfModel(Model, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted vocabulary; adds unit-length vectors row by row. It is written with its terms as parameters."""

    terms = Param(Params._dummy(), "terms", "terms, rare to common", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "idf of each term", TypeConverters.toListFloat)

    def __init__(self, terms: Sequence[str] = (), idf: Sequence[float] = ()):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="features", minDF=2, maxDF=0.9, maxFeatures=20_000, low=1, high=3)
        self._set(terms=list(terms), idf=list(idf))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = dataset.columns
        texts = dataset.withColumn("_text", dataset[self.getInputCol()])
        counted = count_vectors(texts.withColumn("text", texts["_text"]), self.getOrDefault(self.terms), self.getOrDefault(self.idf), self.spec())
        return Normalizer(p=2.0, inputCol="_w", outputCol=self.getOutputCol()).transform(counted).select(*names, self.getOutputCol())


class SharedPipeline(Pipeline):
    """A pipeline that fits its first stages once for all parameter maps of its last one.

    `CrossValidator` asks for a model per parameter map and fold; a plain pipeline would fit the vectoriser for each.
    """

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence) -> Iterator:
        *first, last = self.getStages()
        if any(p.parent != last.uid for m in paramMaps for p in m):
            return super().fitMultiple(dataset, paramMaps)
        ready = Pipeline(stages=first).fit(dataset)
        rows = ready.transform(dataset).select(last.getLabelCol(), last.getFeaturesCol()).persist()
        return _SharedFits(last.fitMultiple(rows, paramMaps), ready.stages, rows, len(paramMaps))


class _SharedFits:
    """The models of a pipeline's last stage behind its fitted first ones. Threads may share it; it frees the rows at last."""

    def __init__(self, fits: Iterator, stages: list, rows: DataFrame, count: int):
        self.fits, self.stages, self.rows, self.left, self.lock = fits, stages, rows, count, Lock()

    def __iter__(self) -> _SharedFits:
        return self

    def __next__(self) -> tuple[int, PipelineModel]:
        index, model = next(self.fits)  # may run in several threads
        with self.lock:
            self.left -= 1
            if not self.left:
                self.rows.unpersist()
        return index, PipelineModel([*self.stages, model])
