"""Profiles by split, class and source: counts, shares, lengths, truncation, terms, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crivo.functions.scores import percent
from crivo.functions.text import GIVEAWAY_TERMS, contains_folded, excerpt, word_tokens
from crivo.functions.tokens import MAX_TOKENS, is_truncated
from crivo.functions.urls import display_host, is_suspicious_page
from crivo.operators.relational import join_nullsafe, with_row
from crivo.sources.corpus import SPLITS, split_rank

def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _pos(name: str = "pos") -> Column:
    return F.count_if(F.col("label") == 1).alias(name)


def _neg(name: str = "neg") -> Column:
    return F.count_if(F.col("label") == 0).alias(name)


def by_split(df: DataFrame, split: str | None) -> DataFrame:
    """Rows of one split; an unknown value keeps every row."""
    return df.where(F.col("split") == split) if split in SPLITS else df


def class_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(_n())


def class_weight(df: DataFrame) -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    neg, pos = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return df.agg(neg.alias("n_neg"), pos.alias("n_pos")).withColumn(
        "weight", F.bround(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), 4)
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, positives, negatives, % positive of the labelled rows and distinct sources per split and in total."""
    per_source = df.groupBy("split", "source").agg(_n(), _pos(), _neg())
    split = F.when(F.grouping("split") == 1, "total").otherwise(F.col("split"))
    return (
        per_source.rollup("split")
        .agg(
            split.alias("part"),
            F.sum("n").alias("n"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.count_distinct("source").alias("sources"),
        )
        .select(
            F.col("part").alias("split"),
            "n",
            "pos",
            "neg",
            percent(F.col("pos"), F.col("pos") + F.col("neg"), 3).alias("pct"),
            "sources",
        )
    )


def dominant_share(df: DataFrame, dominant: Sequence[str]) -> DataFrame:
    """Share of rows and positives inside the dominant sources, and what lies outside."""
    out = ~F.col("source").isin(*dominant)
    per_source = df.groupBy("source").agg(_n(), _pos())
    return per_source.agg(
        percent(F.sum(F.when(~out, F.col("n")).otherwise(0)), F.sum("n")).alias("rows_pct"),
        percent(F.sum(F.when(~out, F.col("pos")).otherwise(0)), F.sum("pos"), 1).alias("pos_pct"),
        F.sum(F.when(out, F.col("n")).otherwise(0)).alias("n_outside"),
        F.sum(F.when(out, F.col("pos")).otherwise(0)).alias("pos_outside"),
        F.count_if(out).alias("sources_outside"),
    )


def source_profile(df: DataFrame, split: str | None = None) -> DataFrame:
    """Rows, positives, % positive of the labelled rows and share of all positives per source."""
    g = by_split(df, split).groupBy("source").agg(_n(), _pos(), _neg())
    return with_row(g, g.agg(F.sum("pos").alias("_total"))).select(
        "source",
        "n",
        "pos",
        percent(F.col("pos"), F.col("pos") + F.col("neg")).alias("pct"),
        "neg",
        percent(F.col("pos"), F.greatest("_total", F.lit(1))).alias("pos_share"),
    )


def source_by_split(df: DataFrame) -> DataFrame:
    """Rows and positives per source in total and per split, missing cells 0."""
    cells = []
    for s in SPLITS:
        here = F.col("split") == s
        cells += [F.count_if(here).alias(f"n_{s}"), F.count_if(here & (F.col("label") == 1)).alias(f"pos_{s}")]
    g = df.groupBy("source").agg(_n().alias("n_total"), _pos("pos_total"), _neg("_neg"), *cells)
    return g.select(
        "source",
        "n_total",
        "pos_total",
        percent(F.col("pos_total"), F.col("pos_total") + F.col("_neg")).alias("pct"),
        *[f"{p}_{s}" for s in SPLITS for p in ("n", "pos")],
    )


def shortcut_sources(df: DataFrame, min_rows: int = 5, min_pct: float = 10.0) -> DataFrame:
    """Sources that nearly tell the class."""
    return (
        source_by_split(df)
        .where((F.col("n_total") >= min_rows) & (F.col("pct") >= min_pct))
        .select("source", "n_total", "pos_total", "pct")
    )


def sources_unseen_in_train(df: DataFrame) -> DataFrame:
    return (
        source_by_split(df)
        .where("n_train = 0 AND (n_dev > 0 OR n_test > 0)")
        .select("source", "n_dev", "pos_dev", "n_test", "pos_test")
    )


def top_rate_sources(df: DataFrame, min_rows: int = 5, k: int = 18) -> DataFrame:
    """The k sources with the highest positive rate."""
    return (
        source_profile(df)
        .where(F.col("n") >= min_rows)
        .orderBy(F.desc("pct"), "source")
        .limit(k)
        .select(display_host(F.col("source")).alias("host"), "n", "pos", "pct")
    )


def outside_top_sources(df: DataFrame, k: int = 2) -> DataFrame:
    """Rows and positives outside the k sources with most rows."""
    g = df.groupBy("source").agg(_n(), _pos())
    top = g.orderBy(F.desc("n"), "source").limit(k).select("source", F.lit(1).alias("_top"))
    marked = g.join(F.broadcast(top), "source", "left")  # k rows
    out = F.col("_top").isNull()
    n_out = F.sum(F.when(out, F.col("n")).otherwise(0))
    p_out = F.sum(F.when(out, F.col("pos")).otherwise(0))
    return marked.agg(
        n_out.alias("n_outside"),
        percent(n_out, F.sum("n"), 1).alias("rows_pct"),
        p_out.alias("pos_outside"),
        percent(p_out, F.greatest(F.sum("pos"), F.lit(1)), 1).alias("pos_pct"),
    )


def suspicious_pages(df: DataFrame, **rules) -> DataFrame:
    return df.where(is_suspicious_page(F.col("url"), **rules)).select("split", "label", "source", "url")


def suspicious_crosstab(df: DataFrame, **rules) -> DataFrame:
    """Suspicious pages per source, one column per (split, label)."""
    cells = [
        F.count_if((F.col("split") == s) & (F.col("label") == y)).alias(f"{s}_{y}") for s in SPLITS for y in (0, 1)
    ]
    return suspicious_pages(df, **rules).groupBy("source").agg(*cells)


def shortest_texts(df: DataFrame, k: int = 8) -> DataFrame:
    """The k shortest texts of each split.

    The rank filter lets Spark keep k rows per split in every task before the shuffle; texts are joined back for
    the k x 3 winners only, a set of known size.
    """
    w = Window.partitionBy("split").orderBy("chars", "doc_id")
    short = (
        df.select("doc_id", "split", F.char_length("text").alias("chars"))
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k)
        .select("doc_id", "chars")
    )
    return df.join(F.broadcast(short), "doc_id").select("split", "chars", "label", "source", "url", "text")


def length_describe(df: DataFrame, by: Sequence[str] = ("split", "label")) -> DataFrame:
    """Character counts per group: count, min, quartiles, p90, mean, max; exact with linear interpolation.

    Lengths are integers, so the percentile buffer holds distinct lengths, not rows.
    """
    q = F.percentile("chars", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)]))
    g = df.select(*by, F.char_length("text").alias("chars")).groupBy(*by).agg(
        _n(),
        F.min("chars").cast("bigint").alias("min"),
        F.max("chars").cast("bigint").alias("max"),
        F.sum("chars").alias("_sum"),
        q.alias("_q"),
    )
    return g.select(
        *by,
        "n",
        "min",
        *[F.bround(F.get("_q", F.lit(i)), 4).alias(name) for i, name in enumerate(("q25", "p50", "q75", "p90"))],
        F.bround(F.col("_sum").cast("double") / F.col("n"), 4).alias("mean"),
        "max",
    )


def token_describe(df: DataFrame, by: Sequence[str] = ("split", "label")) -> DataFrame:
    """Token counts per group: count, min, 50/75/90/95 %, max. Needs an integer column `tokens`."""
    q = F.percentile("tokens", F.array(*[F.lit(p) for p in (0.5, 0.75, 0.9, 0.95)]))
    g = df.groupBy(*by).agg(
        _n(), F.min("tokens").cast("bigint").alias("min"), F.max("tokens").cast("bigint").alias("max"), q.alias("_q")
    )
    return g.select(
        *by,
        "n",
        "min",
        *[F.bround(F.get("_q", F.lit(i)), 4).alias(name) for i, name in enumerate(("p50", "p75", "p90", "p95"))],
        "max",
    )


def truncation_by_class(df: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Median, upper quartile and truncated share per split and label, and one row ('all', NULL) for the whole."""
    # Folding to (split, label, tokens) first keeps the two grouping sets from doubling the rows.
    folded = df.groupBy("split", "label", "tokens").agg(_n())
    n, cut = F.sum("n"), F.sum(F.when(is_truncated(F.col("tokens"), limit), F.col("n")).otherwise(0))
    q = F.percentile("tokens", F.array(F.lit(0.5), F.lit(0.75)), F.col("n"))
    parts = folded.groupingSets([["split", "label"], []], "split", "label").agg(
        F.grouping("split").alias("_all"), n.alias("n"), q.alias("_q"), cut.alias("truncated")
    )
    return parts.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"),
        "label",
        "n",
        F.bround(F.get("_q", F.lit(0)), 4).alias("med"),
        F.bround(F.get("_q", F.lit(1)), 4).alias("q75"),
        "truncated",
        percent(F.col("truncated"), F.col("n"), 1).alias("pct"),
    )


def context_coverage(df: DataFrame, limits: Sequence[int] = (512, 1024, 2048, 4096)) -> DataFrame:
    """Share of each class whose tokens fit each limit."""
    g = df.groupBy("label").agg(_n(), *[F.count_if(F.col("tokens") <= k).alias(f"c{k}") for k in limits])
    cells = F.array(*[F.struct(F.lit(k).alias("limit"), F.col(f"c{k}").alias("covered")) for k in limits])
    return g.select("label", "n", F.explode(cells).alias("e")).select(
        "label", "e.limit", "n", "e.covered", percent(F.col("e.covered"), F.col("n"), 2).alias("pct")
    )


def _histogram(df: DataFrame, binned: Column, bins: int) -> DataFrame:
    """Counts and % of class for every (label, bin); empty bins are rows of 0, out-of-range rows count in the base."""
    g = df.groupBy("label", binned.alias("bin")).agg(_n())
    total = g.groupBy("label").agg(F.sum("n").alias("total"))  # one row per class, and one for rows without a label
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return join_nullsafe(grid, F.broadcast(g.where("bin IS NOT NULL")), ["label", "bin"], "left").select(
        "label", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "total",
        percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("pct"),
    )


def length_histogram(df: DataFrame, low: float = 2.0, high: float = 4.7, bins: int = 27) -> DataFrame:
    """Character lengths per class in equal log10 bins, the last one closed on the right.

    Bin `lower` is 10**edge, rounded.
    """
    width = (high - low) / bins
    x = F.log10(F.greatest(F.char_length("text"), F.lit(1)).cast("double"))
    cell = F.floor((x - low) / width).cast("int")
    binned = F.when(x == high, bins - 1).when((x >= low) & (x < high), F.least(cell, F.lit(bins - 1)))
    h = _histogram(df.select("label", "text"), binned, bins)
    return h.withColumn("lower", F.bround(F.pow(F.lit(10.0), F.lit(low) + F.col("bin") * width), 0).cast("bigint"))


def token_histogram(df: DataFrame, width: int = 64, tail: int = 1472) -> DataFrame:
    """Token counts per class in equal bins from 0; the last bin takes everything from `tail` on."""
    bins = tail // width + 1
    binned = F.floor(F.least(F.col("tokens"), F.lit(tail + width - 1)) / width).cast("int")
    h = _histogram(df, binned, bins)
    start = (F.col("bin") * width).cast("string")
    return h.withColumn("range", F.when(F.col("bin") == bins - 1, F.concat(start, F.lit("+"))).otherwise(start))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """The figures shown beside a histogram: n, truncated median, truncated upper quartile, max, per class.

    Counts per value fold first, so the percentiles see distinct values, not rows.
    """
    values = df.groupBy("label", F.col(column).alias("v")).agg(_n())
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.75)), F.col("n"))
    return values.groupBy("label").agg(F.sum("n").alias("n"), q.alias("_q"), F.max("v").cast("bigint").alias("max")).select(
        "label",
        "n",
        F.floor(F.get("_q", F.lit(0))).alias("median"),
        F.floor(F.get("_q", F.lit(1))).alias("q75"),
        "max",
    )


def token_stats(df: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Truncated median of `tokens` and % of the rows over the limit, per class."""
    values = df.groupBy("label", "tokens").agg(_n())
    cut = F.sum(F.when(is_truncated(F.col("tokens"), limit), F.col("n")).otherwise(0))
    q = F.percentile("tokens", F.lit(0.5), F.col("n"))
    return values.groupBy("label").agg(F.sum("n").alias("n"), F.floor(q).alias("median"), cut.alias("truncated")).withColumn(
        "pct", percent(F.col("truncated"), F.col("n"), 1)
    )


def term_prevalence(df: DataFrame, terms: Sequence[str] = GIVEAWAY_TERMS) -> DataFrame:
    """Documents and positives that contain each term, in one scan of the texts."""
    lowered = df.select("label", F.lower("text").alias("_t"))
    flags = lowered.select("label", *[F.contains("_t", F.lit(t.lower())).alias(f"_m{i}") for i, t in enumerate(terms)])
    aggs = []
    for i in range(len(terms)):
        aggs += [F.count_if(F.col(f"_m{i}")).alias(f"d{i}"), F.count_if(F.col(f"_m{i}") & (F.col("label") == 1)).alias(f"p{i}")]
    row = flags.agg(*aggs)
    cells = [
        F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("docs"), F.col(f"p{i}").alias("pos"))
        for i, t in enumerate(terms)
    ]
    return (
        row.select(F.explode(F.array(*cells)).alias("e"))
        .select("e.*")
        .withColumn("pct_pos", percent(F.col("pos"), F.col("docs"), 1))
    )


def source_terms(df: DataFrame, min_docs: int = 5, min_share: float = 0.5) -> DataFrame:
    """Terms concentrated in one source: the largest share of a term's documents that one source holds."""
    pairs = df.select("source", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    by_source = pairs.groupBy("term", "source").agg(_n())
    best = by_source.groupBy("term").agg(
        F.sum("n").alias("docs"), F.min(F.struct((-F.col("n")).alias("o"), "source", "n")).alias("b")
    )
    share = F.col("b.n").cast("double") / F.col("docs")
    return best.where((F.col("docs") >= min_docs) & (share >= min_share)).select(
        "term", "docs", F.col("b.source").alias("source"), F.col("b.n").alias("source_docs"),
        F.bround(share, 4).alias("share"),
    )


def pattern_audit(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Rows, positives and sources that match each named pattern."""
    per_source = df.groupBy("source").agg(
        *[F.count_if(F.col("text").rlike(p)).alias(f"n_{k}") for k, p in patterns.items()],
        *[F.count_if(F.col("text").rlike(p) & (F.col("label") == 1)).alias(f"p_{k}") for k, p in patterns.items()],
    )
    cells = [
        F.struct(F.lit(k).alias("pattern"), F.col(f"n_{k}").alias("n"), F.col(f"p_{k}").alias("p")) for k in patterns
    ]
    return (
        per_source.select(F.explode(F.array(*cells)).alias("e"))
        .groupBy(F.col("e.pattern").alias("pattern"))
        .agg(
            F.sum("e.n").alias("docs"),
            F.sum("e.p").alias("pos"),
            F.count_if(F.col("e.n") > 0).alias("sources"),
        )
    )


def search_filter(
    df: DataFrame, split: str | None = None, source: str | None = None, label: int | None = None, q: str | None = None
) -> DataFrame:
    """Rows that meet every given condition; unset ones do not filter."""
    df = by_split(df, split)
    if source:
        df = df.where(F.col("source") == source)
    if label in (0, 1):
        df = df.where(F.col("label") == label)
    needle = (q or "").strip().lower()
    return df.where(contains_folded(F.col("text"), needle)) if needle else df


def search_total(df: DataFrame, **conditions) -> DataFrame:
    return search_filter(df, **conditions).agg(F.count(F.lit(1)).alias("total"))


def sample_search(df: DataFrame, page: int = 0, size: int = 25, **conditions) -> DataFrame:
    """One page of the matching rows in split and key order, with the start of each text."""
    hits = search_filter(df, **conditions).select(
        "doc_id", "split", "source", "label", "url",
        F.char_length("text").cast("bigint").alias("chars"), excerpt(F.col("text"), 320).alias("excerpt"),
    )
    return hits.orderBy(split_rank("split"), "doc_id").offset(max(page, 0) * size).limit(size)


def sorted_page(df: DataFrame, column: str, descending: bool = False, page: int = 0, size: int = 25) -> DataFrame:
    """One page of the rows in the order of any column, NULL last, ties by key."""
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(order, "doc_id").offset(max(page, 0) * size).limit(size)


def search_after(df: DataFrame, last: tuple[str, int] | None, size: int = 25, **conditions) -> DataFrame:
    """The page after the row (split, doc_id): deep pages cost no more than the first."""
    hits = search_filter(df, **conditions)
    if last:
        rank = SPLITS.index(last[0])
        r = split_rank("split")
        hits = hits.where((r > rank) | ((r == rank) & (F.col("doc_id") > last[1])))
    return sample_search(hits, 0, size)
