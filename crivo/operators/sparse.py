"""Sparse rows inside a task: postings, and the meetings of two sides over their common terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EXPAND = 1 << 22  # products expanded at once inside a task


class Rows:
    """Sparse rows of a cell as flat arrays: entry row, term and weight, with terms ascending inside a row."""

    def __init__(self, table: pa.Table):
        idx, w = table["idx"].combine_chunks(), table["w"].combine_chunks()
        self.n = table.num_rows
        self.ptr = idx.offsets.to_numpy().astype(np.int64)
        self.ptr -= self.ptr[0]
        self.idx = idx.flatten().to_numpy().astype(np.int64)
        self.w = w.flatten().to_numpy()
        self.row = np.repeat(np.arange(self.n), np.diff(self.ptr))

    def left(self) -> np.ndarray:
        """Norm of each entry and all later ones of its row."""
        sq = np.concatenate(([0.0], np.cumsum(self.w * self.w)))
        return np.sqrt(np.maximum(sq[self.ptr[1:]][self.row] - sq[:-1], 0.0))

    def by_term(self, keep: np.ndarray | None = None, value: np.ndarray | None = None):
        """(terms, first, count, rows, values): the entries regrouped by term, optionally only some of them."""
        keep = slice(None) if keep is None else keep
        idx, row, w = self.idx[keep], self.row[keep], (self.w if value is None else value)[keep]
        order = np.argsort(idx, kind="stable")
        terms, first, count = np.unique(idx[order], return_index=True, return_counts=True)
        return terms, first, count, row[order], w[order]


def fan_out(idx: np.ndarray, terms: np.ndarray, first: np.ndarray, count: np.ndarray):
    """How many postings each entry meets, and where they start."""
    if not len(terms):
        return np.zeros(len(idx), dtype=np.int64), np.zeros(len(idx), dtype=np.int64)
    spot = np.minimum(np.searchsorted(terms, idx), len(terms) - 1)
    return np.where(terms[spot] == idx, count[spot], 0), first[spot]


def expand(fan: np.ndarray, start: np.ndarray):
    """(entry, posting) index pairs of all meetings."""
    entry = np.repeat(np.arange(len(fan)), fan)
    posting = np.arange(len(entry)) - np.repeat(np.cumsum(fan) - fan, fan) + start[entry]
    return entry, posting


def chunks(sizes: np.ndarray, most: int, most_rows: int):
    """Consecutive row ranges with at most `most` meetings and `most_rows` rows each, at least one row."""
    done = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = int(np.searchsorted(done, done[a] + most, side="right")) - 1
        b = max(a + 1, min(b, len(sizes), a + max(1, most_rows)))
        yield a, b
        a = b
