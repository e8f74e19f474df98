"""Language identification with a string kernel.

A text's profile is the set of its byte n-grams of lengths 1 to 3 (blended spectrum, presence only), hashed to a fixed
number of cells; two texts' kernel is the number of cells they share, divided by the geometric mean of their sizes.
Landmark texts give the Nystroem features K(x, L) (K(L, L) + e)^-1/2, on which one ridge regression per language (1 for its own texts,
-1 for others) is solved in closed form. The fit uses a bounded sample, chosen by hash: at most
`rows` texts, the same number for each language; scoring takes whole texts, a batch of profiles times the landmark matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from crivo.session import ship

CELLS = 1 << 14
SAMPLE = 2000
HASH_PARTS = 16
LEARN_CHARS = 20_000
LANDMARKS = 96
RIDGE = 1e-3
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def profile(text: str, out: np.ndarray) -> None:
    """Set the cells of `out` for the n-grams of a text."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    for lo in range(0, len(b), 1 << 20):  # pieces overlap, so no n-gram is missed
        p = b[lo : lo + (1 << 20) + 2]
        out[p % CELLS] = 1
        if len(p) > 1:
            two = p[:-1] * np.uint32(257) + p[1:]
            out[(two * np.uint32(2654435761) >> np.uint32(13)) % CELLS] = 1
        if len(p) > 2:
            three = two[:-1] * np.uint32(257) + p[2:]
            out[(three * np.uint32(2246822519) >> np.uint32(11)) % CELLS] = 1


def profiles(texts: list[str]) -> np.ndarray:
    """Profiles scaled to length 1, so that their products are kernel values."""
    out = np.zeros((len(texts), CELLS), np.float32)
    for row, text in zip(out, texts):
        profile(text, row)
    out /= np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))
    return out


@dataclass
class Model:
    """Landmark profiles and, per language, the weights of kernel values with the landmarks."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return profiles(texts) @ self.landmarks.T @ self.weights + self.offset


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on texts that come in a random order; landmarks are taken from the languages in turn."""
    languages = sorted(set(langs))
    x = profiles(texts)
    turn: dict[str, int] = {}
    order = []
    for lang in langs:
        turn[lang] = turn.get(lang, 0) + 1
        order.append(turn[lang])
    chosen = np.argsort(order, kind="stable")[: max(landmarks, len(languages))]
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = (x @ marks.T).astype(np.float64) @ root
    target = np.where(np.array(langs)[:, None] == np.array(languages), 1.0, -1.0)
    share = (target > 0).mean(0)
    heft = np.where(target > 0, 0.5 / share, 0.5 / np.maximum(1 - share, 1e-9)) / len(x)  # both sides of a language weigh alike
    weights, offset = np.zeros((len(marks), len(languages))), np.zeros(len(languages))
    for k in range(len(languages)):
        h = heft[:, k]
        mean_x, mean_y = h @ features / h.sum(), h @ target[:, k] / h.sum()
        centred = features - mean_x
        gram = centred.T @ (centred * h[:, None]) + ridge * np.eye(len(marks))
        w = np.linalg.solve(gram, centred.T @ (h * (target[:, k] - mean_y)))
        weights[:, k], offset[k] = root @ w, mean_y - mean_x @ w
    return Model(languages, marks, weights.astype(np.float32), offset.astype(np.float32))


def sample(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` labelled texts, the same number for each language, one at least, the most frequent languages first.

    A text over LEARN_CHARS characters gives a piece of that size at a hashed place. Rows are chosen and ordered by the hash
    of their text. Only a table of more than `rows` languages has languages without a text here.
    """
    usable = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.where("lang IS NOT NULL AND text <> ''").withColumn("h", F.xxhash64("text"))
    keys = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).select("lang")
    each = max(1, rows // max(1, keys.count()))
    small = usable.select("lang", "h").join(F.broadcast(keys), "lang").distinct().withColumn("part", F.pmod("h", F.lit(HASH_PARTS)))
    for by in (["lang", "part"], ["lang"]):  # a language may have most of the rows: first the best of each part of it
        small = small.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("h"))).where(F.col("rank") <= each)
    chosen = usable.join(F.broadcast(small.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h"])
    room = F.greatest(F.length("text") - LEARN_CHARS, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("h"), room) + 1).cast("int"), F.lit(LEARN_CHARS))
    return chosen.orderBy("h", "lang").select("lang", piece.alias("text"))


def learn(docs: DataFrame, rows: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on the bounded sample of `docs` (text, lang); None if no row can be learned from."""
    got = [(r["text"], r["lang"]) for r in sample(docs, rows).toLocalIterator() if _LETTER.search(r["text"])]
    return fit([t for t, _ in got], [g for _, g in got], landmarks, ridge) if got else None


def predict(docs: DataFrame, model: Model | None, batch_rows: int = 128) -> DataFrame:
    """Add lang_pred and score to the rows of `docs` (text, ...); columns of these names are replaced.

    The score is the softmax of the languages' ridge outputs, 0 to 1. A text that is null or has no letter is `und` with
    score 0, and so is every text if nothing could be learned. Equal outputs go to the first language in order. Repeated rows
    are labelled alike; an empty table stays empty.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # landmarks x cells: a fixed size

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            known = np.flatnonzero([m is not None and isinstance(t, str) and _LETTER.search(t) is not None for t in texts])
            for lo in range(0, len(known), batch_rows):
                at = known[lo : lo + batch_rows]
                out = m.scores([texts.iat[i] for i in at])
                e = np.exp(4 * (out - out.max(1, keepdims=True)))
                best = out.argmax(1)
                langs[at] = [m.languages[k] for k in best]
                scores[at] = e[np.arange(len(at)), best] / e.sum(1)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.withColumn("_found", label(F.col("text").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))
