"""Masking of terms that come from the data, thousands of them, in place of one long alternation."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MOST_TERMS = 50_000
_WORD = re.compile(r"\w+")


class Masker:
    """Finds the longest term that starts at each word; terms are words, or words with what stands between them."""

    def __init__(self, terms: list[str], mask: str = " "):
        self.mask = mask
        self.by_first: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for term in {t.lower() for t in terms}:
            words = _WORD.findall(term)
            if words:
                self.by_first[words[0]][len(words)].add(term)

    def __call__(self, text: str) -> str:
        words = list(_WORD.finditer(text))
        out, done, at = [], 0, 0
        while at < len(words):
            lengths = self.by_first.get(words[at].group().lower())
            step = 1
            for n in sorted(lengths or (), reverse=True):
                start, end = words[at].start(), words[min(at + n, len(words)) - 1].end()
                if at + n <= len(words) and text[start:end].lower() in lengths[n]:
                    out += [text[done:start], self.mask]
                    done, step = end, n
                    break
            at += step
        return "".join([*out, text[done:]])


def mask_by_terms(df: DataFrame, terms: DataFrame, most_terms: int = MOST_TERMS, mask: str = " ") -> DataFrame:
    """`df` (text, ...) with every whole-word occurrence of a term of `terms` (term) replaced, whatever its case.

    Of terms that start at one word the longest counts. The terms go to every worker as one table of at most `most_terms`;
    more are an error, as leaving some out would change the result: pass fewer, say those of the most documents.
    """
    listed = [r["term"] for r in terms.select("term").where("term IS NOT NULL").distinct().limit(most_terms + 1).collect()]
    if len(listed) > most_terms:
        raise ValueError(f"more than {most_terms} terms to mask")
    shared = df.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("string")
    def masked(batches: pd.Series) -> pd.Series:
        masker = Masker(shared.value, mask)
        return batches.map(lambda t: None if t is None else masker(t))

    return df.withColumn("text", masked(F.col("text")))
