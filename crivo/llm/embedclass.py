"""Text quality by supervised subword embeddings.

A text is the mean of the learned vectors of its features: every word, the character n-grams of the word between marks,
and every pair of neighbouring words, all hashed into one table; a word after itself is the pair "again", whatever the word,
and line ends and the text's end are words too. A softmax layer turns the mean into class probabilities. Vectors and layer are
trained together by stochastic gradient descent in numpy. Because the layer is linear, scoring adds up one number per class
for each feature, and a word's own features are added up once per worker, not once per occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from crivo.session import ship

ROWS = 600  # labelled documents of each class to learn from, at most
LEARN_CHARS = 8_000  # characters of each, a piece at a hashed place if it is longer
BUCKETS = 1 << 18
WIDTH = 8
GRAMS = (3, 4)
PIECE = 1 << 20
BATCH_WORDS = 300_000
CACHE_WORDS, CACHE_CHARS = 150_000, 4_000_000
LINE, END = "\x00", "\x01"
_SPACE = re.compile(r"\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def words(text: str) -> Iterator[list[str]]:
    """The text's words in order, in lists of bounded size: runs without white space, line ends, and the end of the text.

    A run that goes on 1000 characters past a list's bound is cut there.
    """
    at = 0
    while len(text) - at > PIECE:
        gap = _SPACE.search(text, at + PIECE, at + PIECE + 1000)
        to = gap.start() if gap else min(len(text), at + PIECE + 1000)
        yield text[at:to].replace("\n", f" {LINE} ").split()
        at = to
    yield [*text[at:].replace("\n", f" {LINE} ").split(), END]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, buckets, the word each bucket belongs to): the words themselves and their character n-grams."""
    joined = "".join(f"\x02{t}\x03" for t in tokens)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(7)
    sizes = np.array([len(t) + 2 for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    whole = _spread(np.add.reduceat(_spread(codes * _MIX + place * _BASE), starts))
    buckets, owners = [whole % np.uint64(BUCKETS)], [np.arange(len(tokens))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * _BASE + codes[j : len(codes) - n + 1 + j]
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append(_spread(h[inside]) % np.uint64(BUCKETS))
        owners.append(owner[: len(h)][inside])
    return whole, np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


AGAIN = 0


def pair_buckets(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, given their hashes."""
    h = _spread(before * _BASE + (after ^ _MIX)) % np.uint64(BUCKETS)
    return np.where(before == after, AGAIN, h).astype(np.int64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text; the weights sum to 1."""
    tokens = [t for part in words(text) for t in part]
    known = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    ids = np.array([known[t] for t in tokens])
    whole, buckets, owner = word_features(list(known))
    times = np.bincount(ids, minlength=len(known))
    pairs = pair_buckets(whole[ids[:-1]], whole[ids[1:]])
    at, where = np.unique(np.concatenate([buckets, pairs]), return_inverse=True)
    weight = np.bincount(where, np.concatenate([times[owner], np.ones(len(pairs))]))
    return at, (weight / weight.sum()).astype(np.float32)


@dataclass
class Model:
    """Feature vectors, zero where nothing was learned, and the softmax layer with its bias in the last row."""

    vectors: np.ndarray  # BUCKETS x WIDTH
    layer: np.ndarray  # (WIDTH + 1) x classes
    classes: list[int]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 60.0, batch: int = 8, seed: int = 0) -> Model | None:
    """Train on texts and their labels; None without at least two classes. The rate falls to zero in a straight line."""
    classes = sorted(set(labels))
    if len(classes) < 2:
        return None
    seen = [document_features(t) for t in texts]
    y = np.array([classes.index(v) for v in labels])
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = r.normal(0, 1, (WIDTH + 1, len(classes))).astype(np.float32)
    layer[-1] = 0
    steps, done = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            sizes = np.array([len(seen[j][0]) for j in rows])
            at, weight = np.concatenate([seen[j][0] for j in rows]), np.concatenate([seen[j][1] for j in rows])
            mean = np.add.reduceat(vectors[at] * weight[:, None], np.cumsum(sizes) - sizes)
            mean = np.column_stack([mean, np.ones(len(rows), np.float32)])
            miss = softmax(mean @ layer)
            miss[np.arange(len(rows)), y[rows]] -= 1
            now = rate * (1 - done / steps)
            back = miss @ layer[:-1].T
            layer -= 0.01 * now * mean.T @ miss / len(rows)
            np.subtract.at(vectors, at, now * weight[:, None] * np.repeat(back, sizes, axis=0))
            done += 1
    known = np.zeros(BUCKETS, bool)
    for at, _ in seen:
        known[at] = True
    vectors[~known] = 0
    return Model(vectors, layer.astype(np.float32), classes)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Model | None:
    """Fit on a bounded sample of the rows of `docs` (doc_id, text) that `labels` (doc_id, <label>) covers.

    At most `rows` documents of each class 0 and 1, chosen by the hash of the identifier, and LEARN_CHARS characters of each: a
    longer one gives a piece at a hashed place. Of several labels of a document the largest counts, of several texts the
    least; null and empty texts and null labels are not learned from. None if a class is missing.
    """
    doc = F.col("doc_id").cast("long").alias("doc_id")
    marked = labels.where(f"{label} IN (0, 1) AND doc_id IS NOT NULL").groupBy(doc).agg(F.max(F.col(label).cast("int")).alias("_y"))
    marked = marked.join(docs.where("text <> ''").select(doc), "doc_id", "left_semi")
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    some = marked.where("_y = 1").orderBy(order).limit(rows).union(marked.where("_y = 0").orderBy(order).limit(rows))
    room = F.greatest(F.length("text") - LEARN_CHARS, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), room) + 1).cast("int"), F.lit(LEARN_CHARS)).alias("text")
    text = docs.where("text <> ''").select(doc, F.col("text").cast("string").alias("text"))
    got = text.join(F.broadcast(some), "doc_id").select("doc_id", "_y", piece).groupBy("doc_id").agg(F.max("_y").alias("y"), F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["y"], r["text"]) for r in got.collect())  # 2 * rows at most
    return fit([t for _, _, t in found], [y for _, y, _ in found])


class Scorer:
    """Class scores of texts; each distinct word's features are added up once and kept for the next texts."""

    def __init__(self, model: Model):
        self.table = model.vectors @ model.layer[:-1]  # what a feature adds to each class
        self.bias = model.layer[-1]
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.whole, self.sums, self.counts = np.empty(0, np.uint64), np.empty((0, self.table.shape[1])), np.empty(0)
        self.chars = 0

    def _learn_words(self, new: list[str]) -> None:
        whole, buckets, owner = word_features(new)
        sums = np.column_stack([np.bincount(owner, column, len(new)) for column in self.table[buckets].T])
        self.whole = np.concatenate([self.whole, whole])
        self.sums = np.concatenate([self.sums, sums])
        self.counts = np.concatenate([self.counts, np.bincount(owner, minlength=len(new))])
        self.chars += sum(map(len, new))

    def _numbers(self, text: str) -> np.ndarray:
        out = []
        for part in words(text):
            new = [t for t in dict.fromkeys(part) if t not in self.ids]
            if new:
                self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
                self.fresh += new
            out.append(np.fromiter(map(self.ids.__getitem__, part), np.int64, len(part)))
        return np.concatenate(out)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row per text, a column per class."""
        if len(self.ids) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        self.fresh: list[str] = []
        each = [self._numbers(t) for t in texts]
        if self.fresh:
            self._learn_words(self.fresh)
        sizes = np.array([len(a) for a in each])  # a text has its end at least
        ids = np.concatenate(each)
        starts = np.cumsum(sizes) - sizes
        pairs = np.zeros((len(ids), self.table.shape[1]))
        pairs[1:] = self.table[pair_buckets(self.whole[ids[:-1]], self.whole[ids[1:]])]
        pairs[starts] = 0
        total = np.add.reduceat(self.sums[ids] + pairs, starts)
        count = np.add.reduceat(self.counts[ids], starts) + sizes - 1
        return softmax(total / count[:, None] + self.bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add score, the probability of the model's last class, to the rows of `docs` (text, ...), replacing a column of that name.

    Every word of a text counts, however long it is. Null and empty texts have the score of a text that only ends. Without a
    model every score is 0.5. Repeated rows have equal scores; an empty table stays empty.
    """
    ship(docs.sparkSession)
    names = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*names, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH floats, 8 MB

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for column in batches:
            held, size, out = [], 0, []
            for text in column:
                held.append(text if isinstance(text, str) else "")
                size += len(held[-1]) // 6 + 1
                if size >= BATCH_WORDS:
                    out.append(scorer.probabilities(held)[:, -1])
                    held, size = [], 0
            if held:
                out.append(scorer.probabilities(held)[:, -1])
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select(*names, judge(F.col("text").cast("string")).alias("score"))
