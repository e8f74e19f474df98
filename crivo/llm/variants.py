"""Spelling variants: words of a vocabulary that are one inserted, deleted or replaced character apart.

Two words are one edit apart if their common prefix and their common suffix together reach the longer one's length less
one. Then one of the two covers half of that length, so near words meet in a block of words that agree in their first or
in their last half. In a block the words are rows of padded code-point matrices; blocks of rows are compared pair by pair,
one column at a time, which gives the prefix and suffix lengths of all pairs of two blocks at once.

A block that is too large is cut further by the same argument: what its words have not yet in common is again halved. In the
end words differ in one place only, so a block has no more words than there are letters. A pair that meets in two blocks is
counted in the one reached by prefixes: a block reached by a suffix step leaves out pairs that agree in that step's
other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from crivo.operators.relational import join_groups
from crivo.session import materialise, ship

CELLS = 1 << 16  # words of a block times their length, before the block is cut
TILE = 512
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = ("size", "left", "right", "below")


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): the words of at least `shortest` characters that occur `least` times in the texts of `docs` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where `slip` divides h, the crc32 of
    "<doc_id>:<word>", the word loses its character number h modulo its length; None leaves words alone. A null text has no
    words, a null doc_id is empty text; a repeated row counts again.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("word"))
    words = words.withColumn("word", F.translate("word", UPPER, LOWER))
    if slip:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary")))
        at = F.expr("cast(h % length(word) AS int)")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("word", F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word"))).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, size, left, right, below) in the two blocks that agree in half of what was still open.

    `size` is the longer length the block is about; `left` and `right` characters are in common; pairs are counted if their common
    prefix is shorter than `below`.
    """
    half = F.expr("(size - left - right) div 2")
    by_prefix = F.struct((F.col("left") + half).alias("left"), F.col("right"), F.col("below"))
    by_suffix = F.struct(F.col("left"), (F.col("right") + half).alias("right"), (F.col("left") + half).alias("below"))
    return rows.select("word", "n", "size", F.explode(F.array(by_prefix, by_suffix)).alias("b")).select("word", "n", "size", "b.*")


def _keyed(rows: DataFrame) -> DataFrame:
    start = F.substring("word", F.lit(1), F.col("left").cast("int"))
    end = F.substring("word", F.expr("cast(length(word) - right + 1 AS int)"), F.col("right").cast("int"))
    return rows.withColumn("block", F.concat_ws("/", *BLOCK, start, F.when(F.col("right") > 0, end).otherwise("")))


def blocks(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """The rows of `words` (word, n) in blocks of at most `cells` characters: (block, word, n, size, left, right, below).

    Any two near words meet in a block, and are to be counted in one. Larger blocks than `cells` differ in one place only.
    """
    size = F.length("word").cast("long")
    whole = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("size"))
    rows = _halved(whole.select("*", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), (F.col("size") + 1).alias("below")))
    done = None
    while True:
        keyed = materialise(_keyed(rows), "variant-rows")
        sizes = keyed.groupBy("block").agg(F.count("*").alias("words")).where("words > 1")  # a word alone has no near word here
        sized = materialise(join_groups(keyed, sizes, "block", "words", "word"), "variant-blocks")
        whole = F.expr(f"words * size <= {cells} OR size - left - right <= 1")
        ready, large = sized.where(whole).drop("words"), sized.where(~whole)
        done = ready if done is None else done.unionByName(ready)
        if large.isEmpty():
            return done
        rows = _halved(large)


def _run_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and each of b, in how many first columns they agree; one column of both at a time."""
    same = np.ones((a.shape[1], b.shape[1]), bool)
    total = np.zeros(same.shape, np.int32)
    for x, y in zip(a, b):
        same &= x[:, None] == y[None, :]
        if not same.any():
            break
        total += same
    return total


class _Block:
    """Words of one block, most frequent first, as two matrices with a column per word: from the front and from the back."""

    def __init__(self, words: list[str], size: int, left: int, right: int, below: int):
        self.open, self.left, self.below = size - left - right, left, below
        self.length = np.array([len(w) for w in words])
        codes = np.zeros((len(words), size + 1), np.uint32)
        for i, w in enumerate(words):
            codes[i, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)  # column 0 and the rest pad
        if codes.max(initial=0) < 256:
            codes = codes.astype(np.uint8)
        self.size = size
        self.front = np.ascontiguousarray(codes[:, 1 + left : 1 + left + self.open].T)
        ends = self.length - right
        columns = ends[:, None] - np.arange(self.open)[None, :]  # column c + 1 holds character c; column 0 pads
        self.back = np.ascontiguousarray(np.take_along_axis(codes, np.maximum(columns, 0), 1).T)

    def near(self, rows: slice, others: slice) -> np.ndarray:
        """Which rows are one edit from which others, of the pairs to be counted here."""
        prefix = _run_lengths(self.front[:, rows], self.front[:, others])
        suffix = _run_lengths(self.back[:, rows], self.back[:, others])
        longest = np.maximum(self.length[rows][:, None], self.length[others][None, :]) == self.size
        return (prefix + suffix >= self.open - 1) & (prefix + self.left < self.below) & longest


def near_in_block(words: list[str], size: int, left: int, right: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(near words, index of the first near word or the number of words) for each word of a block, tile by tile."""
    block, count = _Block(words, size, left, right, below), len(words)
    step = max(1, min(TILE, (1 << 22) // max(1, block.open)))
    found, first = np.zeros(count, np.int64), np.full(count, count)
    for i in range(0, count, step):
        rows = slice(i, min(count, i + step))
        for j in range(i, count, step):
            others = slice(j, min(count, j + step))
            near = block.near(rows, others)
            if i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            for here, there, mark in ((rows, others, near), (others, rows, near.T)) if i != j else ((rows, others, near),):
                hits = mark.sum(axis=1)
                found[here] += hits
                at = np.where(hits > 0, mark.argmax(axis=1) + there.start, count)
                first[here] = np.minimum(first[here], at)
    return found, first


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the words of each block; rows come sorted by block, a block may go on in the next batch."""

    def judged(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names, at = np.unique(rows["block"].to_numpy(str), return_index=True)
        at = np.sort(at)
        words, n = rows["word"].tolist(), rows["n"].to_numpy()
        shape = rows[list(BLOCK)].to_numpy()
        kept: list[tuple] = []
        for i, j in zip(at, [*at[1:], len(rows)]):
            order = sorted(range(i, j), key=lambda k: (-n[k], words[k]))
            found, first = near_in_block([words[k] for k in order], *map(int, shape[i]))
            for k in np.flatnonzero(found):
                best = order[first[k]]
                kept.append((words[order[k]], int(found[k]), int(n[best]), words[best]))
        yield pd.DataFrame(kept, columns=["word", "n_near", "form_n", "form"])

    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        last = rows["block"].iloc[-1]
        if held and rows["block"].iloc[0] == last == held[0]["block"].iloc[-1]:
            held.append(rows)
            continue
        rows = pd.concat([*held, rows], ignore_index=True)
        open_ = (rows["block"] == last).to_numpy()
        if not open_.all():
            yield from judged(rows[~open_].reset_index(drop=True))
        held = [rows[open_]]
    if held:
        yield from judged(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """(word, n_near, form_n, form) of the words in `words` (word, n) with a word one edit away.

    `form` is the near word with the largest n, the smallest in code-point order of several. Words are distinct.
    """
    ship(words.sparkSession)
    rows = blocks(words, cells).repartition("block").sortWithinPartitions("block")
    found = rows.mapInPandas(_compare, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def variants(words: DataFrame, times: int = 10, cells: int = CELLS) -> DataFrame:
    """Each word of `words` (word, n; distinct words) with its form and root: word, form, root, n, n_near, form_n.

    The form is the near word with the largest n (smallest in code-point order of several) if that is at least `times`
    the word's n, else null. The root is where the forms lead; a word without a form is its own. n_near counts the words one
    edit away. Null words are left out; an empty table stays empty.
    """
    words = materialise(words.where("word IS NOT NULL").select("word", "n"), "variant-words")
    near = near_words(words, cells)
    out = words.join(near, "word", "left").withColumn("named", F.expr(f"form_n >= {times} * n"))
    out = out.select(
        "word", F.expr("CASE WHEN named THEN form END AS form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("CASE WHEN named THEN form_n END AS form_n")
    )
    out = materialise(out, "variant-forms")
    links = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the steps; counts grow tenfold at each step, so there are few
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialise(moved, "variant-links")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    out = out.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
