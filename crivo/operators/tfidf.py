"""TF-IDF as relations: term counts, a capped vocabulary, weights per (document, term), and row vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F

from crivo.functions.text import ngrams, word_tokens
from crivo.operators.relational import with_row
from crivo.operators.sparse import chunks
from crivo.session import materialise, ship


@dataclass(frozen=True)
class TfidfSpec:
    """Vectoriser settings. `max_df` is a share of the documents; `max_features` bounds the vocabulary."""

    min_df: int = 1
    max_df: float = 1.0
    max_features: int | None = None
    sublinear: bool = False
    low: int = 1
    high: int = 1


# The settings of the audit, the pool check and the classifier.
AUDIT = TfidfSpec(min_df=2, max_df=0.5, max_features=200_000, sublinear=True)
POOL = TfidfSpec(max_features=20_000, sublinear=True)
CLASSIFIER = TfidfSpec(min_df=2, max_df=0.9, max_features=20_000, low=1, high=3)
TASK_BYTES = 8 << 20  # text of a task that counts terms per document
WORDS = 1 << 20  # words counted at once inside a task


def term_counts(df: DataFrame, spec: TfidfSpec = AUDIT, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf). A document without a term keeps one row with a NULL term.

    The text is shuffled once by key, TASK_BYTES of it to a task; counting and every later grouping by key then need no exchange.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    base = df.select(key, *keep, "text").repartition(tasks, key)
    base = base.select(key, *keep, word_tokens(F.col("text")).alias("_words"))
    terms = ngrams(F.col("_words"), spec.low, spec.high)
    return base.select(key, *keep, F.explode_outer(terms).alias("term")).groupBy(key, *keep, "term").agg(
        F.count("term").alias("tf")
    )


def _counter(spec: TfidfSpec, by: str | None):
    """Arrow batches of word lists to (by, term, df, total), each term of a batch once; terms are built from numbers."""

    def count(words: pa.ListArray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = words.flatten().dictionary_encode()
        names, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        groups, group = np.unique(group, return_inverse=True)
        gram = codes
        for n in range(1, spec.high + 1):
            if n > 1:
                gram = np.unique(gram[:-1] * len(names) + codes[n - 1 :], return_inverse=True)[1]
            if n < spec.low:
                continue
            at = np.flatnonzero(row[: len(gram)] == row[n - 1 :])  # the others reach into the next text
            key, first, of, total = np.unique(gram[at] * len(groups) + group[row[at]], return_index=True, return_inverse=True, return_counts=True)
            pairs = np.unique(row[at] * len(key) + of)
            df = np.bincount(pairs % max(len(key), 1), minlength=len(key))
            parts = [names.take(pa.array(codes[at[first] + i])) for i in range(n)]
            term = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
            cols = {"term": term, "df": pa.array(df, pa.int64()), "total": pa.array(total, pa.int64())}
            if by is not None:
                cols[by] = pa.array(groups[key % len(groups)], pa.int32())
            yield pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_words")
            group = np.zeros(batch.num_rows, np.int64) if by is None else batch.column(by).to_numpy()
            for a, b in chunks(np.diff(lists.offsets.to_numpy()), WORDS, batch.num_rows):
                if lists.offsets[b].as_py() > lists.offsets[a].as_py():
                    yield from count(pa.concat_arrays([lists.slice(a, b - a)]), group[a:b])

    return run


def term_totals(df: DataFrame, spec: TfidfSpec, by: str | None = None) -> DataFrame:
    """(term, df, total): documents that hold each term and its occurrences, with `by` (a whole number) per value of that column.

    Terms fold in each batch of texts and in each task, so only per-term sums are shuffled, never the text.
    """
    ship(df.sparkSession)
    keys = [by] if by is not None else []
    words = F.coalesce(word_tokens(F.col("text")), F.array().cast("array<string>")).alias("_words")
    rows = df.select(*[F.col(k).cast("int").alias(k) for k in keys], words)
    schema = "term string, df long, total long" + "".join(f", {k} int" for k in keys)
    return rows.mapInArrow(_counter(spec, by), schema).groupBy("term", *keys).agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(df: DataFrame, spec: TfidfSpec) -> DataFrame:
    """(term, df, total, idf, idx): document-frequency limits first, then the cap on total count, ties by term.

    `idx` numbers the kept terms from rare to common.
    """
    return _limited(term_totals(df, spec), df.agg(F.count(F.lit(1)).alias("_docs")), spec)


def outside_vocabularies(df: DataFrame, spec: TfidfSpec, by: str, values: Sequence[int]) -> list[DataFrame]:
    """For each value the vocabulary of the rows whose `by` is another one: the texts are counted once, and a value's own counts subtracted."""
    own = term_totals(df, spec, by)
    pick = lambda c, v: F.coalesce(F.sum(F.when(F.col(by) == v, F.col(c))), F.lit(0))
    sums = [F.sum(c).alias(c) for c in ("df", "total")] + [pick(c, v).alias(f"{c}_{v}") for c in ("df", "total") for v in values]
    wide = materialise(own.groupBy("term").agg(*sums), "term-totals")
    sizes = materialise(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "fold-sizes")  # a row per value
    out = []
    for v in values:
        left = wide.select("term", (F.col("df") - F.col(f"df_{v}")).alias("df"), (F.col("total") - F.col(f"total_{v}")).alias("total"))
        docs = sizes.where(F.col(by) != v).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_docs"))
        out.append(_limited(left.where("df > 0"), docs, spec))
    return out


def _limited(terms: DataFrame, docs: DataFrame, spec: TfidfSpec) -> DataFrame:
    """`vocabulary` from the terms' totals and the one-row number of documents."""
    kept = (
        with_row(terms.where(F.col("df") >= spec.min_df), docs)
        .where(F.col("df") <= F.col("_docs") * spec.max_df)
        .withColumn("idf", F.ln((1.0 + F.col("_docs")) / (1.0 + F.col("df"))) + 1.0)
        .drop("_docs")
    )
    if spec.max_features is None:
        return kept
    top = most_frequent(kept, spec.max_features)
    # At most max_features rows, so one task may number them.
    order = Window.partitionBy(F.lit(0)).orderBy("df", "term")
    return top.withColumn("idx", F.row_number().over(order) - 1)


def most_frequent(terms: DataFrame, k: int) -> DataFrame:
    """The k terms with the highest total, ties by term, without sending every partition's best k to one task.

    Counts per total tell at which total rank k lies: higher ones are in, lower ones out. Within it, counts per first
    two and then four letters narrow the tie down alike; only terms that agree on all three are put in order.
    """
    rows = materialise(terms, "terms").withColumn("_left", F.lit(k).cast("bigint"))
    out = None
    for value in (-F.col("total"), F.substring("term", 1, 2), F.substring("term", 1, 4)):
        rows = rows.withColumn("_v", value)
        per_value = rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"), F.max("_left").alias("_left"))
        upto = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_v"))  # one row per distinct value
        running = per_value.withColumn("_upto", upto).where("_upto >= _left")
        at = F.min(F.struct("_v", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("rest")))
        marked = with_row(rows, running.agg(at.alias("_edge")))
        inside = marked.where("_edge IS NULL OR _v < _edge._v").select(*terms.columns)
        out = inside if out is None else out.unionByName(inside)
        rows = marked.where("_v = _edge._v").withColumn("_left", F.col("_edge.rest")).drop("_edge")
    order = Window.partitionBy(F.lit(0)).orderBy("term")
    ties = rows.withColumn("_r", F.row_number().over(order)).where("_r <= _left").select(*terms.columns)
    return out.unionByName(ties)


def collect_vocabulary(vocab: DataFrame, spec: TfidfSpec) -> tuple[list[str], list[float]]:
    """Terms and idf in idx order on the driver; only a vocabulary bounded by max_features may come here."""
    if spec.max_features is None:
        raise ValueError("set max_features: the vocabulary is sent to every task")
    rows = vocab.select("idx", "term", "idf").toArrow().sort_by("idx")
    return rows["term"].to_pylist(), rows["idf"].to_pylist()


def count_vectors(df: DataFrame, terms: list[str], idf: list[float], spec: TfidfSpec) -> DataFrame:
    """Adds `_tf` (term counts) and `_w` (counts times idf) as sparse vectors, row by row in the JVM, without a shuffle."""
    words = df.withColumn("_words", F.coalesce(word_tokens(F.col("text")), F.array().cast("array<string>")))
    tokens = words.withColumn("_terms", ngrams(F.col("_words"), spec.low, spec.high))
    count = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w")
    return scale.transform(count.transform(tokens)).drop("_words", "_terms")


def _bounded(vocab: DataFrame, spec: TfidfSpec) -> DataFrame:
    """Broadcast the vocabulary only where max_features bounds it."""
    return F.broadcast(vocab) if spec.max_features is not None else vocab


def _tf(spec: TfidfSpec):
    tf = F.col("tf").cast("double")
    return 1.0 + F.ln(tf) if spec.sublinear else tf


def tfidf_weights(counts: DataFrame, vocab: DataFrame, spec: TfidfSpec, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): L2-normalised rows."""
    joined = counts.join(_bounded(vocab.select("term", "idf"), spec), "term")
    raw = joined.select(key, "term", (_tf(spec) * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("weight"))


def _vectoriser(vocab, sublinear: bool, keep: tuple[str, ...]):
    """Arrow batches of word lists to sparse rows; the vocabulary arrives once per worker as a broadcast."""

    def vectorise(batches):
        terms, idf = pa.array(vocab.value[0], pa.string()), np.asarray(vocab.value[1])
        size = max(len(idf), 1)
        for batch in batches:
            lists = batch.column("_terms")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy()
            code, tf = np.unique((rows * size + at)[at >= 0], return_counts=True)
            row, idx = code // size, (code % size).astype(np.int32)
            v = (1.0 + np.log(tf) if sublinear else tf) * idf[idx]
            w = v / np.sqrt(np.bincount(row, v * v, batch.num_rows))[row]
            ptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            marks = [
                hashlib.md5(idx[a:b].tobytes() + tf[a:b].tobytes()).hexdigest() for a, b in zip(ptr[:-1], ptr[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.ListArray.from_arrays(pa.array(ptr), pa.array(idx, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ptr), pa.array(w, pa.float64())),
                    pa.array(marks, pa.string()),
                ],
                names=[*keep, "idx", "w", "sig"],
            )

    return vectorise


def tfidf_vectors(df: DataFrame, vocab: DataFrame, spec: TfidfSpec, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: idx (terms, rare to common), w (unit-length weights) and sig.

    Row by row, without a shuffle. `sig` is equal for documents with the same terms and counts. A document without
    terms has empty arrays.
    """
    ship(df.sparkSession)
    bound = df.sparkSession.sparkContext.broadcast(collect_vocabulary(vocab, spec))  # at most max_features terms
    words = F.coalesce(word_tokens(F.col("text")), F.array().cast("array<string>"))
    base = df.select(*keep, words.alias("_words"))
    base = base.select(*keep, ngrams(F.col("_words"), spec.low, spec.high).alias("_terms"))
    fields = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, idx array<int>, w array<double>, sig string"
    return base.mapInArrow(_vectoriser(bound, spec.sublinear, keep), schema)
