"""Many linear SVMs in one pass: every feature count, penalty and fold of a grid is a column of one weight matrix.

The objective of a model is half the squared norm of its weights, the intercept included, plus C times the sum of its rows'
squared hinges. Rows stay where they are: an evaluation sends the weights to the tasks and brings back the sum of the tasks'
losses and gradients, added up on the cluster in blocks of columns. L-BFGS steps are taken side by side for all models with the
same number of features, as far as their weights are bounded. So what the driver holds at once is a few times MOST_WEIGHTS numbers and
the finished weights, whatever the number of rows.

Rows of at most LOCAL_ENTRIES terms in all are no work for the cluster: then each task reads all of them and takes the same steps for
some of the models by itself, without a job per step.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crivo.operators.blockfiles import can_open, read_files
from crivo.operators.sparse import EXPAND
from crivo.session import ship

STEPS = (1.0, 0.5, 0.25, 0.125, 1 / 16, 1 / 64)
MEMORY = 6
MOST_WEIGHTS = 1 << 19  # of the models fitted side by side
SENT = 1 << 17  # losses and gradients in one row
LOCAL_ENTRIES = 8_000_000  # terms of all rows that one task may hold: 100 MB
ROWS = "label int, fold int, idx array<int>, w array<double>"


@dataclass(frozen=True)
class Setting:
    """One model: it sees the first `features` terms, and all rows but those of `fold` (-1: all)."""

    features: int
    c: float
    fold: int = -1


class Rows:
    """The rows of a task: (label, fold, idx, w), idx being a term's rank by frequency."""

    def __init__(self, table: pa.Table, counts: Sequence[int]):
        idx, w = table["idx"].combine_chunks(), table["w"].combine_chunks()
        self.n = table.num_rows
        self.ptr = idx.offsets.to_numpy().astype(np.int64)
        self.ptr -= self.ptr[0]
        self.idx, self.w = idx.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy()
        self.y = np.where(table["label"].to_numpy() == 1, 1.0, -1.0)
        self.fold = table["fold"].to_numpy() if "fold" in table.column_names else np.full(self.n, -2)
        row = np.repeat(np.arange(self.n), np.diff(self.ptr))
        norms = {k: np.sqrt(np.bincount(row, self.w**2 * (self.idx < k), self.n)) for k in set(counts)}
        #: what a model's vector is divided by, as it has unit length over the terms that the model knows; 0 / 1 is an empty one
        self.scale = np.stack([1 / np.where(norms[k] > 0, norms[k], 1) for k in counts], axis=1)

    def chunks(self, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, rows a..b as a dense matrix of `width` terms); matrix products pay off at a text's density."""
        step = max(1, EXPAND // width)
        for a in range(0, self.n, step):
            b = min(self.n, a + step)
            part = slice(self.ptr[a], self.ptr[b])
            dense = np.zeros((b - a, width), np.float32)
            known = self.idx[part] < width
            dense[np.repeat(np.arange(b - a), np.diff(self.ptr[a : b + 1]))[known], self.idx[part][known]] = self.w[part][known]
            yield a, b, dense

    def margins(self, a: int, b: int, dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Decision values of rows a..b under every model; the last row of `weights` holds the intercepts."""
        return (dense @ weights[:-1]) * self.scale[a:b] + weights[-1]


def evaluate(rows: Rows, settings: Sequence[Setting], weights: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(losses at every step along `direction`, gradient at the whole step), without the penalty on the weights."""
    c = np.array([s.c for s in settings])
    folds = np.array([s.fold for s in settings])
    losses, gradient = np.zeros((len(STEPS), len(settings))), np.zeros(weights.shape)
    moves = direction.any()
    for a, b, dense in rows.chunks(len(weights) - 1):
        here, along = rows.margins(a, b, dense, weights), rows.margins(a, b, dense, direction) if moves else 0.0
        used = rows.fold[a:b, None] != folds[None, :]
        y = rows.y[a:b, None]
        for i, t in enumerate(STEPS if moves else STEPS[:1]):
            slack = np.maximum(0.0, 1 - y * (here + t * along)) * used
            losses[i] += c * (slack * slack).sum(axis=0)
            if i == 0:
                push = -2 * c * y * slack
                gradient[:-1] += dense.T @ (push * rows.scale[a:b]).astype(np.float32)
                gradient[-1] += push.sum(axis=0)
    return losses, gradient


def _sum(df: DataFrame, settings: Sequence[Setting], weights: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`evaluate` over all rows: per task, then per block of columns over all tasks; the driver gets each block once."""
    shared = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), direction.astype(np.float32)))
    counts = [s.features for s in settings]
    step = max(1, SENT // (len(STEPS) + len(weights)))
    blocks = range(0, len(settings), step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            if batch.num_rows:
                made = np.vstack(evaluate(Rows(pa.Table.from_batches([batch]), counts), settings, *shared.value))
                whole = made if whole is None else whole + made
        if whole is not None:
            for a in blocks:
                part = whole[:, a : a + step].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([part], pa.binary())], names=["part", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["total"])
        return pa.table({"part": table["part"][:1], "total": pa.array([total.tobytes()], pa.binary())})

    made = df.mapInArrow(run, "part int, total binary")
    if df.rdd.getNumPartitions() > 1:
        made = made.groupBy("part").applyInArrow(add, "part int, total binary")
    total = np.zeros((len(STEPS) + len(weights), len(settings)))
    for r in made.toLocalIterator():
        a = r["part"]
        total[:, a : a + step] += np.frombuffer(r["total"]).reshape(len(total), -1)
    shared.unpersist()
    return total[: len(STEPS)], total[len(STEPS) :]


def _two_loops(g: np.ndarray, history: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS direction of every column; a column whose pair was refused has rho 0 there."""
    q, alphas = g.copy(), []
    for s, y, rho in reversed(history):
        alphas.append(rho * (s * q).sum(axis=0))
        q -= alphas[-1] * y
    if history:
        s, y, rho = history[-1]
        scale = np.where(rho > 0, (s * y).sum(axis=0) / np.maximum((y * y).sum(axis=0), 1e-300), 1.0)
        q *= scale
    else:
        q /= np.maximum(1.0, np.sqrt((q * q).sum(axis=0)))
    for (s, y, rho), alpha in zip(history, reversed(alphas)):
        q += s * (alpha - rho * (y * q).sum(axis=0))
    return -q


def fit_many(df: DataFrame, settings: Sequence[Setting], max_iter: int = 40, tolerance: float = 3e-3) -> np.ndarray:
    """Weights of every setting, a column each, the intercept last; `df` is a written table of ROWS.

    A column stands still once its gradient has fallen to `tolerance` of what it was at the start.
    """
    spark = df.sparkSession
    ship(spark)
    out = np.zeros((max(s.features for s in settings) + 1, len(settings)))
    if can_open(spark) and df.inputFiles() and (df.agg(F.sum(F.size("idx"))).first()[0] or 0) <= LOCAL_ENTRIES:
        for columns, w in _fit_apart(df, settings, max_iter, tolerance):
            out[: len(w) - 1, columns], out[-1, columns] = w[:-1], w[-1]
        return out
    for k in sorted({s.features for s in settings}):
        same = [i for i, s in enumerate(settings) if s.features == k]
        step = max(1, MOST_WEIGHTS // (k + 1))
        for at in range(0, len(same), step):
            columns = same[at : at + step]
            mine = [settings[i] for i in columns]
            w = _fit(lambda w, d, mine=mine: _sum(df, mine, w, d), mine, max_iter, tolerance)
            out[:k, columns], out[-1, columns] = w[:-1], w[-1]
    return out


def _fit_apart(df: DataFrame, settings: Sequence[Setting], max_iter: int, tolerance: float) -> Iterator[tuple[list[int], np.ndarray]]:
    """(settings' numbers, their weights) from tasks that read all rows of the written table and fit some models of one feature count each."""
    files, spark = sorted(df.inputFiles()), df.sparkSession
    each = max(1, -(-len(settings) // (2 * spark.sparkContext.defaultParallelism)))
    groups = []
    for k in sorted({s.features for s in settings}, reverse=True):  # the longest work first
        same = [i for i, s in enumerate(settings) if s.features == k]
        step = min(each, max(1, MOST_WEIGHTS // (k + 1)))
        groups += [same[at : at + step] for at in range(0, len(same), step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                mine = [settings[i] for i in groups[at]]
                rows = Rows(read_files(files), [s.features for s in mine])
                w = _fit(lambda w, d: evaluate(rows, mine, w.astype(np.float32), d.astype(np.float32)), mine, max_iter, tolerance)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([w.tobytes()], pa.binary())], names=["at", "w"])

    made = spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, "at int, w binary")
    for r in made.collect():  # the finished weights
        columns = groups[r["at"]]
        yield columns, np.frombuffer(r["w"]).reshape(-1, len(columns))


def _fit(total: Callable, settings: Sequence[Setting], max_iter: int, tolerance: float) -> np.ndarray:
    """The models of some settings, side by side; `total` gives `evaluate` over all rows."""
    k = max(s.features for s in settings)
    counts = np.array([s.features for s in settings])
    known = np.vstack([np.arange(k)[:, None] < counts[None, :], np.ones((1, len(settings)), bool)])
    w = np.zeros((k + 1, len(settings)))
    still = np.zeros_like(w)

    def whole(losses, weights):
        return losses + 0.5 * (weights * weights).sum(axis=0)

    losses, g = total(w, still)
    f, g = losses[0], g * known
    start = np.sqrt((g * g).sum(axis=0))
    history: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        open_ = np.sqrt((g * g).sum(axis=0)) > tolerance * start
        if not open_.any():
            break
        d = _two_loops(g, history) * open_
        slope = (g * d).sum(axis=0)
        d = np.where(slope < 0, d, -g * open_)
        slope = (g * d).sum(axis=0)
        losses, gradient = total(w, d)
        tried = np.array([whole(x, w + t * d) for x, t in zip(losses, STEPS)])
        good = tried <= f + 1e-4 * np.array(STEPS)[:, None] * slope
        pick = np.where(good.any(axis=0), good.argmax(axis=0), len(STEPS) - 1)
        step = np.array(STEPS)[pick]
        moved = w + step * d
        if (step[open_] != 1.0).any():
            _, gradient = total(moved, still)
        new = (gradient + moved) * known
        s, y = moved - w, new - g
        curve = (s * y).sum(axis=0)
        rho = np.where(open_ & (curve > 1e-12), 1 / np.where(curve > 1e-12, curve, 1.0), 0.0)
        history = [*history, (s, y, rho)][-MEMORY:]
        w, g, f = moved, new, tried[pick, np.arange(len(settings))]
    return w


def fold_counts(df: DataFrame, settings: Sequence[Setting], weights: np.ndarray) -> np.ndarray:
    """(tp, fp, fn) of every setting over the rows of its own fold, at margin 0."""
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    counts, folds = [s.features for s in settings], np.array([s.fold for s in settings])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(settings)), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = Rows(pa.Table.from_batches([batch]), counts)
                for a, b, dense in rows.chunks(len(shared.value) - 1):
                    hit, mine = rows.margins(a, b, dense, shared.value) >= 0, rows.fold[a:b, None] == folds[None, :]
                    true = (rows.y[a:b, None] > 0) & mine
                    total += np.array([(true & hit).sum(axis=0), (mine & ~true & hit).sum(axis=0), (true & ~hit).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.int64())], names=["at", "n"])

    got = df.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # three numbers a setting
    out = np.zeros(3 * len(settings), np.int64)
    for r in got:
        out[r["at"]] = r["n"]
    return out.reshape(3, -1)


def margins(df: DataFrame, settings: Sequence[Setting], weights: np.ndarray) -> DataFrame:
    """`df` (idx, w, label, ...) once per setting: without idx and w, with `setting` (its number) and `score`."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    counts = [s.features for s in settings]
    keep = [c for c in df.columns if c not in ("idx", "w", "fold")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(pa.Table.from_batches([batch]), counts)
            for a, b, dense in rows.chunks(len(shared.value) - 1):
                scores = rows.margins(a, b, dense, shared.value)
                for i in range(len(settings)):
                    part = [batch.column(c).slice(a, b - a) for c in keep]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(b - a, i), pa.int32()), pa.array(scores[:, i])], names=[*keep, "setting", "score"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{fields}, setting int, score double")
