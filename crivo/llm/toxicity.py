"""Toxic spans by a linear-chain conditional random field over words.

Labelled documents give labelled tokens: a word of a toxic document is toxic if one of its features (itself, its first or
last letters) is far more frequent in toxic documents than chance allows; all words of other documents are clean. The
field has two states, feature weights for the toxic one and transition weights, fitted by gradient on the exact
likelihood. Scoring runs forward-backward over whole texts; word marginals give the spans, and a small logistic model
over their maximum and sum gives the document's score.

The chain of a batch of texts is one sequence of 2 x 2 matrices, a text's first one forgetting the state before it. It
is cut into stretches; the products of all stretches are formed side by side, joined, and then filled in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from crivo.session import ship

TOXIC_ROWS = 600
CLEAN_ROWS = 1200
LEARN_CHARS = 20_000
STRETCH = 64
BATCH_WORDS = 400_000
_EDGE = re.compile(r"^\W+|\W+$")
_WORD = re.compile(r"\S+")
LONGEST = 200  # a longer run of characters is cut into pieces, each a word of the chain
_PIECE = re.compile(rf"[^\W_]{{1,{LONGEST}}}|[\W_]{{1,{LONGEST}}}")


def words(text: str) -> list[str]:
    """The words of a text: runs without white space; a run of over LONGEST characters falls apart at its non-letters."""
    found = text.split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [p for w in found for p in ([w] if len(w) <= LONGEST else _PIECE.findall(w))]


def word_places(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the words of a text, in their order."""
    for m in _WORD.finditer(text):
        if m.end() - m.start() <= LONGEST:
            yield m.span()
        else:
            for p in _PIECE.finditer(text, m.start(), m.end()):
                yield p.span()


def features(token: str) -> tuple[str, ...]:
    """A token's features: the bare lower-cased word, its first 3 to 5 and its last 4 letters."""
    word = _EDGE.sub("", token.lower())
    if len(word) < 3:
        return (f"={word}",)
    return (f"={word}", *(f"<{word[:n]}" for n in (3, 4, 5) if len(word) > n), *((f">{word[-4:]}",) if len(word) > 4 else ()))


@dataclass
class Field:
    """Feature weights of the toxic state, potentials of the chain, and the document model."""

    weights: dict[str, float]
    start: np.ndarray  # start[j]
    moves: np.ndarray  # moves[i, j]
    document: np.ndarray  # bias, log odds of the largest marginal, log of 1 + the sum of marginals

    def emission(self, token: str) -> float:
        return min(30.0, max(-30.0, sum(self.weights.get(f, 0.0) for f in features(token))))


class _Emissions(dict):
    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, token: str) -> float:
        value = self.field.emission(token)
        if len(self) > 500_000:
            self.clear()
        if len(token) <= 100:
            self[token] = value
        return value


def _matrices(emission: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    m = np.broadcast_to(np.exp(moves), (len(emission), 2, 2)).copy()
    m[first] = np.exp(start)
    m[:, :, 1] *= np.exp(emission)[:, None]
    return m


def _scan(m: np.ndarray, row: bool) -> np.ndarray:
    """Running products from the left (row vectors) of a chain of 2 x 2 matrices, scaled; `row` false: of transposes."""
    n = len(m)
    width = -(-n // STRETCH)
    pad = np.broadcast_to(np.eye(2), (width * STRETCH, 2, 2)).copy()
    pad[:n] = m if row else m.transpose(0, 2, 1)
    pad = pad.reshape(width, STRETCH, 2, 2)
    whole = np.broadcast_to(np.eye(2), (width, 2, 2))
    for k in range(STRETCH):
        whole = whole @ pad[:, k]
        whole = whole / whole.sum((1, 2), keepdims=True)
    entry = np.empty((width, 2))
    a, b = 0.5, 0.5
    for i, ((p, q), (r, s)) in enumerate(whole.tolist()):
        entry[i] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    out = np.empty((width, STRETCH, 2))
    state = entry
    for k in range(STRETCH):
        state = np.einsum("ni,nij->nj", state, pad[:, k])
        state = state / state.sum(1, keepdims=True)
        out[:, k] = state
    return out.reshape(-1, 2)[:n]


def forward_backward(emission: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, 2) of the states, and (n, 2, 2) of the moves into each position, of texts laid end to end.

    `first` marks the first word of each text; moves into it are 0.
    """
    m = _matrices(emission, first, start, moves)
    alpha = _scan(m, True)
    back = _scan(m[::-1], False)[::-1]  # back[t] = M_t M_t+1 ... 1
    beta = np.vstack([back[1:], [[0.5, 0.5]]])
    states = alpha * beta
    states /= states.sum(1, keepdims=True)
    pairs = np.zeros((len(m), 2, 2))
    pairs[1:] = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
    pairs[first] = 0
    total = pairs.sum((1, 2), keepdims=True)
    return states, pairs / np.where(total > 0, total, 1)


def label_features(toxic: list[set[str]], clean: list[set[str]], times: float = 20.0) -> set[str]:
    """Features whose share of toxic documents is `times` that of clean ones, and which chance alone would not give.

    The least log-likelihood ratio rises with the number of features looked at, so that about one passes by chance.
    """
    n1, n0 = Counter(f for s in toxic for f in s), Counter(f for s in clean for f in s)
    a, b = len(toxic), len(clean)
    least = 2 * log(len(n1) + 1)

    def part(x: float, expected: float) -> float:
        return x * log(x / expected) if x else 0.0

    out = set()
    for f, x in n1.items():
        y = n0[f]
        if x / a < times * y / b:
            continue
        p = (x + y) / (a + b)
        g = 2 * (part(x, a * p) + part(y, b * p) + part(a - x, a * (1 - p) or 1) + part(b - y, b * (1 - p) or 1))
        if g >= least:
            out.add(f)
    return out


def fit(toxic: list[str], clean: list[str], steps: int = 40, ridge: float = 1e-5, rate: float = 0.3) -> Field:
    """Fit the field on toxic and clean texts."""
    sides = [[words(t) for t in texts] for texts in (toxic, clean)]
    known = {w: features(w) for side in sides for words in side for w in words}
    marks = label_features(*[[{f for w in words for f in known[w]} for words in side] for side in sides])
    is_toxic = {w for w, fs in known.items() if marks.intersection(fs)}
    learned = [(w, True) for w in sides[0] if is_toxic.intersection(w)] + [(w, False) for w in sides[1] if w]
    field = Field({}, np.zeros(2), np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0]))
    if not learned or not marks:
        return field
    seen = Counter(f for words, _ in learned for w in set(words) for f in known[w])
    index = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= 3)}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in learned for w in words))}
    at = [[index[f] for f in known[w] if f in index] for w in vocabulary]
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    cols = np.array([i for x in at for i in x], int)
    word = np.array([vocabulary[w] for words, _ in learned for w in words])
    gold = np.array([t and w in is_toxic for words, t in learned for w in words])
    sizes = np.array([len(words) for words, _ in learned])
    first = np.zeros(len(word), bool)
    first[np.cumsum(sizes) - sizes] = True

    n_feat = len(index)
    theta = np.zeros(n_feat + 6)  # features, start, moves
    theta[n_feat + 1] = theta[n_feat + 3] = theta[n_feat + 5] = -3.0
    inner = ~first
    target = np.bincount(word, gold, len(vocabulary))
    want_start = np.array([(~gold[first]).sum(), gold[first].sum()], float)
    before, after = gold[:-1][inner[1:]].astype(int), gold[1:][inner[1:]].astype(int)
    want_moves = np.bincount(before * 2 + after, minlength=4).astype(float)
    total_sq = np.full(len(theta), 1e-8)
    for _ in range(steps):  # AdaGrad on the whole sample
        emission = np.bincount(rows, theta[cols], len(vocabulary))
        states, pairs = forward_backward(np.clip(emission, -30, 30)[word], first, theta[n_feat : n_feat + 2], theta[n_feat + 2 :].reshape(2, 2))
        miss = np.bincount(word, states[:, 1], len(vocabulary)) - target
        grad = np.empty_like(theta)
        grad[:n_feat] = np.bincount(cols, miss[rows], n_feat)
        grad[n_feat : n_feat + 2] = states[first].sum(0) - want_start
        grad[n_feat + 2 :] = pairs.sum(0).ravel() - want_moves
        grad = grad / len(word) + ridge * theta
        total_sq += grad**2
        theta -= rate * grad / np.sqrt(total_sq)
    field = Field({f: float(theta[i]) for f, i in index.items()}, theta[n_feat : n_feat + 2], theta[n_feat + 2 :].reshape(2, 2), field.document)

    every = [w for side in sides for w in side]
    y = np.array([1.0] * len(sides[0]) + [0.0] * len(sides[1]))
    x = np.array([summary(p) for p in marginals(every, field, _Emissions(field))])
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(3), x.T @ (p - y) + 0.05 * w)
    field.document = w
    return field


def marginals(texts: list[list[str]], field: Field, emissions: dict) -> list[np.ndarray]:
    """The toxic state's marginal for every word of every text; texts without words give an empty array."""
    sizes = np.array([len(t) for t in texts], int)
    if not sizes.sum():
        return [np.empty(0) for _ in texts]
    emission = np.fromiter((emissions[w] for t in texts for w in t), float, sizes.sum())
    first = np.zeros(len(emission), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    states, _ = forward_backward(emission, first, field.start, field.moves)
    return np.split(states[:, 1], np.cumsum(sizes)[:-1])


def summary(p: np.ndarray) -> tuple[float, float]:
    """A document's inputs to the document model."""
    if not len(p):
        return (-10.0, 0.0)
    top = min(max(float(p.max()), 4.6e-5), 1 - 4.6e-5)
    return (log(top / (1 - top)), log(1 + float(p[p > 0.01].sum())))


def spans(text: str, p: np.ndarray, cut: float = 0.5) -> list[dict]:
    """Runs of words with a marginal of at least `cut`: start and end in characters, and the largest marginal."""
    out: list[dict] = []
    if not len(p) or p.max() < cut:
        return out
    last = -2
    for i, (start, end) in enumerate(word_places(text)):
        if p[i] >= cut:
            if last == i - 1:
                out[-1]["end"], out[-1]["p"] = end, max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": start, "end": end, "p": float(p[i])})
            last = i
    return out


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Field:
    """Fit on a bounded sample of the rows of `docs` (doc_id, text) that `labels` (doc_id, toxic) covers.

    At most `toxic_rows` and `clean_rows` rows, chosen by the hash of the identifier; of several labels of one document the
    largest counts, null ones do not. Texts of over LEARN_CHARS characters are not learned from.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = docs.where(F.length("text").between(1, LEARN_CHARS)).select(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.join(usable, "doc_id", "left_semi")
    order = F.xxhash64(F.lit("toxic"), F.col("doc_id"))
    some = marked.where("toxic = 1").orderBy(order).limit(toxic_rows).union(marked.where("toxic = 0").orderBy(order).limit(clean_rows))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.join(F.broadcast(some), "doc_id").where(F.length("text").between(1, LEARN_CHARS)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in got.collect())  # toxic_rows + clean_rows at most
    return fit([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """Add score (0 to 1) and spans (start, end, p; in characters) to the rows of `docs` (text, ...).

    Columns of these names are replaced. Null, empty and blank texts have no spans and the score of a text without
    toxic words. Every word of a text is scored, a run of over LONGEST characters piece by piece. Repeated rows are scored alike,
    and an empty table stays empty.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # weights of a bounded sample's features

    @F.pandas_udf("score double, spans array<struct<start: int, end: int, p: double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = shared.value
        emissions = _Emissions(field)
        for column in batches:
            texts = [t if isinstance(t, str) else "" for t in column]
            found: list[list[dict]] = []
            scores: list[float] = []
            held: list[list[str]] = []
            size = 0
            for i, text in enumerate(texts):
                held.append(words(text))
                size += len(held[-1])
                if size >= BATCH_WORDS or i == len(texts) - 1:
                    for t, p in zip(texts[i + 1 - len(held) : i + 1], marginals(held, field, emissions)):
                        z = float(field.document @ (1.0, *summary(p)))
                        scores.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
                        found.append(spans(t, p))
                    held, size = [], 0
            yield pd.DataFrame({"score": pd.Series(scores, dtype=float), "spans": pd.Series(found, dtype=object)})

    names = [c for c in docs.columns if c not in ("score", "spans")]
    out = docs.withColumn("_judged", judge(F.col("text").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("_judged.score").alias("score"), F.col("_judged.spans").alias("spans"))
