"""Case-folded substring search by an index of trigrams.

A text that contains a needle contains all its trigrams. The index lists the documents of each trigram; a search intersects
the lists of the needle's rarest ones and looks for the needle in the texts that remain. A row of a list holds the keys of some
neighbouring documents, so what is shuffled and sorted is trigrams per such group, not per document. Rows are sorted by trigram
over all files, so a search reads a few row groups, and a list of most documents is spread over many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crivo.functions.text import contains_folded
from crivo.operators.sparse import chunks
from crivo.session import materialise, ship

LISTS = 3
CHARACTERS = 1 << 21  # of the texts whose trigrams are listed together
ROWS = 1024  # of those texts
WORTH = 0.5  # a needle whose rarest trigram is in more than this share of the documents is searched by a scan


def _distinct_trigrams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """(first text, texts by trigram, where each trigram's begin, the trigrams) of neighbouring texts, numbered from the first on."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for a, b in chunks(sizes, CHARACTERS, ROWS):
        points = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "replace"), "<u4")
        letters = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
        base, n = len(letters) + 1, b - a
        if base**3 * n >= 1 << 62:  # a code holds three letters and a text
            half = n // 2
            for low, part in ((a, texts[a : a + half]), (a + half, texts[a + half : b])):
                for first, *rest in _distinct_trigrams(part):
                    yield low + first, *rest
            continue
        code = np.searchsorted(letters, points)
        row = np.repeat(np.arange(n), sizes[a:b])
        whole = row[:-2] == row[2:]  # the others reach into the next text
        pairs = np.unique((((code[:-2] * base + code[1:-1]) * base + code[2:]) * n + row[:-2])[whole])
        gram, row = np.divmod(pairs, n)
        start = np.flatnonzero(np.diff(gram, prepend=-1))
        gram = gram[start]
        spelt = letters[np.stack([gram // base**2, gram // base % base, gram % base], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
        yield a, row, start, [spelt[i : i + 3] for i in range(0, len(spelt), 3)]


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, lower-cased text in UTF-8) to (trigram, n, keys), a trigram once per some neighbouring texts."""
    for batch in batches:
        texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        for first, row, start, grams in _distinct_trigrams(texts):
            ends = np.append(start, len(row)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), batch.column(0).take(pa.array(row + first)))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.diff(ends), pa.int64()), keys], names=["trigram", "n", "keys"])


class TrigramIndex:
    """Posting lists (trigram, n, keys) and their lengths under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def build(self, df: DataFrame) -> TrigramIndex:
        """Write the index of the texts of `df` (key, text). Rows with a null text hold no needle and are not listed."""
        ship(self.spark)
        rows = df.select(self.key, F.lower("text").cast("binary").alias("text"))
        posted = rows.mapInArrow(_post, f"trigram string, n long, keys array<{rows.schema[self.key].dataType.simpleString()}>")
        posted = materialise(posted, "postings").withColumn("_first", F.get("keys", F.lit(0)))  # the ranges' sample reads it once more
        posted.repartitionByRange("trigram", "_first").sortWithinPartitions("trigram", "_first").drop("_first").write.parquet(f"{self.path}/lists")
        lengths = self.spark.read.parquet(f"{self.path}/lists").groupBy("trigram").agg(F.sum("n").alias("n"))
        lengths.repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{self.path}/lengths")
        df.agg(F.count("*").alias("rows")).write.parquet(f"{self.path}/size")
        return self

    def candidates(self, needle: str) -> DataFrame | None:
        """(key): documents with the needle's rarest trigrams, all that hold the needle among them; None if a scan is better.

        A needle of fewer than three characters has no trigram.
        """
        folded = needle.lower()
        grams = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
        if not grams:
            return None
        lengths = self.spark.read.parquet(f"{self.path}/lengths").where(F.col("trigram").isin(grams)).collect()  # at most the needle's
        lists = self.spark.read.parquet(f"{self.path}/lists")
        if len(lengths) < len(grams):
            return lists.select(F.explode("keys").alias(self.key)).limit(0)
        rows = self.spark.read.parquet(f"{self.path}/size").first()["rows"]
        rarest = sorted((r["n"], r["trigram"]) for r in lengths)[:LISTS]
        if rarest[0][0] > WORTH * rows:
            return None
        found = lists.where(F.col("trigram").isin([t for _, t in rarest])).select(F.explode("keys").alias(self.key))
        return found.groupBy(self.key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(rarest)).select(self.key)

    def search(self, df: DataFrame, needle: str) -> DataFrame:
        """The rows of `df`, the indexed table, whose text contains `needle`, whatever the case; a blank one is in every text."""
        needle = needle.strip()
        if not needle:
            return df
        among = self.candidates(needle)
        rows = df if among is None else df.join(among, self.key, "left_semi")
        return rows.where(contains_folded(F.col("text"), needle))
