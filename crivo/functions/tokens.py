"""Token counts, truncation and fixed-length encoding."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from crivo.functions.text import word_tokens

SPECIAL_TOKENS = 2
MAX_TOKENS = 512


def estimated_tokens(chars: Column) -> Column:
    """Four characters per token plus the two special tokens, truncated to an integer."""
    return F.floor(chars / 4 + SPECIAL_TOKENS).cast("int")


def word_token_count(text: Column) -> Column:
    """Word tokens plus the two special tokens; the default counter when no tokenizer is at hand."""
    return F.size(word_tokens(text)) + SPECIAL_TOKENS


def tokenizer_count(encode_batch: Callable[[list[str]], list[list[int]]], batch: int = 500):
    """Column function that counts tokens with a caller's tokenizer, `batch` texts per call, without truncation."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        sizes = [len(ids) for i in range(0, len(values), batch) for ids in encode_batch(values[i : i + batch])]
        return pd.Series(sizes, index=texts.index, dtype="int32")

    return count


def is_truncated(tokens: Column, limit: int = MAX_TOKENS) -> Column:
    return tokens > limit


def head_truncate(ids: Column, max_length: int = MAX_TOKENS) -> Column:
    return F.slice(ids, 1, max_length)


def head_tail_truncate(ids: Column, max_length: int = MAX_TOKENS, head: int = 128) -> Column:
    """Keep all ids within the budget, else the first `head` and the last of the rest."""
    budget = max_length - SPECIAL_TOKENS
    tail = budget - head
    if head < 0 or tail < 1:
        raise ValueError("head must leave room for at least one token of the end")
    cut = F.concat(F.slice(ids, 1, head), F.slice(ids, -tail, tail))
    return F.when(F.size(ids) > budget, cut).otherwise(ids)


def encode_fixed(ids: Column, max_length: int, head: int, cls_id: int, sep_id: int, pad_id: int) -> Column:
    """Struct of input_ids, attention_mask and token_type_ids, each of `max_length` entries."""
    kept = head_tail_truncate(ids, max_length, head)
    body = F.concat(F.array(F.lit(cls_id)), kept, F.array(F.lit(sep_id)))
    pad = F.lit(max_length) - F.size(body)
    return F.struct(
        F.concat(body, F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        F.array_repeat(F.lit(0), max_length).alias("token_type_ids"),
    )
