"""Leakage audit and exact curation: overlaps between splits, duplicates, canonical urls, versions, footers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crivo.functions.scores import percent
from crivo.functions.text import folded_hash, norm_hash, normalize_space, raw_hash, strip_footer
from crivo.functions.urls import canonical_url
from crivo.operators.relational import join_groups, join_nullsafe
from crivo.sources.corpus import SPLITS, split_rank

SPLIT_PAIRS = (("train", "dev"), ("train", "test"), ("dev", "test"))

# ---- exact duplicates


def exact_dedup_keys(df: DataFrame, digest: Column | None = None) -> DataFrame:
    """Per normalised text: its copies and the survivor, the first in split order, then key order.

    A minimum folds in every task before the shuffle, so a text with a third of all rows costs one row per task.
    """
    digest = norm_hash(F.col("text")) if digest is None else digest
    first = F.min(F.struct(split_rank("split").alias("rank"), F.col("doc_id"), F.col("split"), F.col("label")))
    return (
        df.select(digest.alias("hash"), "doc_id", "split", "label")
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("copies"), first.alias("first"))
        .select("hash", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.split").alias("split"))
    )


def exact_dedup(df: DataFrame, digest: Column | None = None) -> DataFrame:
    """Drop every copy but the first; NULL texts are copies of each other.

    Few rows go, so these are found and taken out: the corpus itself meets only the keys of repeated texts.
    """
    gone = exact_dedup_removed(df, digest).select(F.col("doc_id").alias("_gone"))
    return df.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def exact_dedup_removed(df: DataFrame, digest: Column | None = None) -> DataFrame:
    """The dropped rows, each with the row that stays."""
    digest = norm_hash(F.col("text")) if digest is None else digest
    keys = exact_dedup_keys(df, digest).where("copies > 1").select(
        "hash", "copies", F.col("doc_id").alias("kept_doc_id"), F.col("split").alias("kept_split")
    )
    rows = df.select("doc_id", "split", "label", "source", digest.alias("hash"))
    return join_groups(rows, keys, "hash", "copies", "doc_id").where("doc_id <> kept_doc_id").drop("copies")


# ---- overlap between splits


def _level_masks(df: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Per level and key value: in which splits it occurs, as three counts. One row per (level, value)."""
    entries = F.array(*[F.struct(F.lit(n).alias("level"), c.alias("value")) for n, c in levels.items()])
    # The hashes are computed in a projection of their own: only (split, level, value) reaches the shuffle.
    long = df.select("split", F.explode(entries).alias("e")).select("split", "e.level", "e.value")
    return long.groupBy("level", "value").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def text_levels() -> dict[str, Column]:
    """The four audit levels: url, raw text, whitespace-normalised text, and that in lower case."""
    t = F.col("text")
    return {"url": F.md5("url"), "raw": raw_hash(t), "norm": norm_hash(t), "lower": folded_hash(t)}


def _pair_counts(masks: DataFrame) -> DataFrame:
    g = masks.groupBy("level").agg(
        *[F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_{b}") for a, b in SPLIT_PAIRS]
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}").alias("common"))
            for a, b in SPLIT_PAIRS
        ]
    )
    return g.select("level", F.explode(cells).alias("e")).select("level", "e.*")


def leakage_matrix(df: DataFrame) -> DataFrame:
    """Distinct values that two splits share, for each level and pair."""
    return _pair_counts(_level_masks(df, text_levels()))


def split_overlap(df: DataFrame) -> DataFrame:
    """Texts (whitespace-normalised) and urls in common, per pair of splits."""
    levels = {k: v for k, v in text_levels().items() if k in ("norm", "url")}
    c = _pair_counts(_level_masks(df, levels))
    return c.groupBy("split_a", "split_b").agg(
        F.sum(F.when(F.col("level") == "norm", F.col("common")).otherwise(0)).alias("texts"),
        F.sum(F.when(F.col("level") == "url", F.col("common")).otherwise(0)).alias("urls"),
    )


def intra_split_dups(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each normalised text, per split."""
    masks = _level_masks(df, {"norm": norm_hash(F.col("text"))})
    extra = masks.agg(*[F.sum(F.greatest(F.col(s) - 1, F.lit(0))).alias(s) for s in SPLITS])
    return extra.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("duplicates")) for s in SPLITS])).alias("e")
    ).select("e.*")


def leakage_guard(df: DataFrame, fail: bool = False) -> DataFrame:
    """Violations only: split pairs with a common text or url, splits with internal copies. Raises when asked."""
    pairs = split_overlap(df).where("texts > 0 OR urls > 0").select("split_a", "split_b", "texts", "urls")
    inner = intra_split_dups(df).where("duplicates > 0").select(
        F.col("split").alias("split_a"),
        F.col("split").alias("split_b"),
        F.col("duplicates").alias("texts"),
        F.lit(0).cast("bigint").alias("urls"),
    )
    problems = pairs.unionByName(inner)
    if fail:
        found = problems.take(len(SPLIT_PAIRS) + len(SPLITS))
        if found:
            raise AssertionError(f"leakage found: {[tuple(r) for r in found]}")
    return problems


def url_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct urls the two tables share."""
    common = left.select("url").distinct().join(right.select("url").distinct(), "url", "left_semi")
    return common.agg(F.count(F.lit(1)).alias("common_urls"))


def assert_no_url_overlap(left: DataFrame, right: DataFrame) -> None:
    n = url_overlap(left, right).first()[0]
    if n:
        raise AssertionError(f"{n} urls in common")


# ---- canonical urls


def canonical_groups(df: DataFrame, drop_suffix: bool = False) -> DataFrame:
    """Canonical urls held by more than one row: n, splits, labels. Cells are bounded by the splits and classes."""
    keyed = df.select(canonical_url(F.col("url"), drop_suffix).alias("canon"), "split", "label")
    g = keyed.groupBy("canon").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"),
        F.array_join(F.array_sort(F.collect_set("label")).cast("array<string>"), "+").alias("labels"),
    )
    return g.where("n > 1")


def canonical_members(df: DataFrame, drop_suffix: bool = False) -> DataFrame:
    """The urls of each such group as rows, not as one joined cell: a group has no size limit."""
    rows = df.select(canonical_url(F.col("url"), drop_suffix).alias("canon"), "doc_id", "url", "split", "label")
    groups = canonical_groups(df, drop_suffix).select("canon", "n", "splits", "labels")
    joined = join_groups(
        rows.select("canon", "doc_id", "url", F.col("split").alias("url_split"), F.col("label").alias("url_label")),
        groups, "canon", "n", "doc_id",
    )
    return joined.select("canon", "n", "splits", "labels", "doc_id", "url", "url_split", "url_label")


def canonical_summary(df: DataFrame, modes: Sequence[str] = ("basic", "aggressive")) -> DataFrame:
    """Per mode: groups, those across splits, within one split, and with conflicting labels."""
    out = None
    for mode in modes:
        g = canonical_groups(df, mode == "aggressive")
        cross = F.contains("splits", F.lit("+"))
        row = g.agg(
            F.lit(mode).alias("mode"),
            F.count(F.lit(1)).alias("groups"),
            F.count_if(cross).alias("cross_split"),
            F.count_if(~cross).alias("intra_split"),
            F.count_if(F.contains("labels", F.lit("+"))).alias("label_conflict"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def canonical_split_counts(df: DataFrame, drop_suffix: bool = False) -> DataFrame:
    """Groups per combination of splits."""
    return canonical_groups(df, drop_suffix).groupBy("splits").agg(F.count(F.lit(1)).alias("groups"))


# ---- integrity, versions, fingerprint, footer


def integrity_audit(df: DataFrame, columns: Sequence[str] = ("url", "text", "label", "source")) -> DataFrame:
    """Rows, NULLs per column, repeated urls and repeated whole rows, per split."""
    marks = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in columns]
    # One scan: each row offers its url's digest and its own; both fold per task, so only distinct digests are shuffled.
    empty = F.struct(*[F.col(c).isNull().alias(f"null_{c}") for c in columns])
    offers = F.array(
        F.struct(F.lit("url").alias("kind"), F.coalesce(F.md5("url"), F.lit("-")).alias("mark")),
        F.struct(F.lit("row").alias("kind"), F.md5(F.concat_ws(",", *marks)).alias("mark")),
    )
    long = df.select("split", empty.alias("_empty"), F.explode(offers).alias("o"))
    folded = long.groupBy("split", "o.kind", "o.mark").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"_empty.null_{c}")).alias(f"null_{c}") for c in columns]
    )
    row, url = F.col("kind") == "row", F.col("kind") == "url"
    return folded.groupBy("split").agg(
        F.sum(F.when(row, F.col("n"))).alias("rows"),
        *[F.sum(F.when(row, F.col(f"null_{c}"))).alias(f"null_{c}") for c in columns],
        F.sum(F.when(url, F.col("n") - 1)).alias("dup_urls"),
        F.sum(F.when(row, F.col("n") - 1)).alias("dup_rows"),
    )


def reconcile_versions(old: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "url") -> DataFrame:
    """Full join of two versions on a unique key: rows per side, mismatches per column, texts equal after normalising.

    An empty or NULL key names no row, so such rows count as unmatched on their own side.
    """
    return reconciled(reconcile_counts(old, new, columns, key), "text" in columns)


def reconciled(counts: DataFrame, with_text: bool) -> DataFrame:
    """The counts with the share of equal texts in place of their number."""
    if not with_text:
        return counts
    return counts.withColumn("text_equal_pct", percent(F.col("same_text"), F.col("matched"), 1)).drop("same_text")


def reconcile_counts(old: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "url") -> DataFrame:
    """One row of additive counts; `same_text` of matched rows whose texts are equal after normalising."""
    def side(df: DataFrame, name: str) -> DataFrame:
        # Texts are compared by digest, so none is shuffled. A row without a key gets one of its own: it matches nothing.
        digests = [F.md5(F.col(c).cast("string")).alias(f"{name}_{c}") for c in columns]
        if "text" in columns:
            digests.append(F.md5(normalize_space(F.col("text"))).alias(f"{name}_norm"))
        lone = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.concat(F.lit(name), F.monotonically_increasing_id().cast("string")))
        return df.select(F.col(key).alias("_key"), lone.alias("_lone"), *digests, F.lit(True).alias(f"_{name}"))

    j = join_nullsafe(side(old, "a"), side(new, "b"), ["_key", "_lone"], "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = [
        F.count("_a").alias("old_rows"),
        F.count("_b").alias("new_rows"),
        F.count_if(both).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias("only_old"),
        F.count_if(F.col("_a").isNull()).alias("only_new"),
        *[F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"diff_{c}") for c in columns],
    ]
    if "text" in columns:
        aggs.append(F.count_if(both & F.col("a_norm").eqNullSafe(F.col("b_norm"))).alias("same_text"))
    return j.agg(*aggs)


def dataset_diff(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Rows that left and rows that came between two versions, per split and label."""
    gone = old.join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    came = new.join(old.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    cols = ["change", "split", "label"]
    return gone.select(cols).unionByName(came.select(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def table_fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    """Order-independent content mark: row count and the sums of two parts of each row's md5.

    The sums are decimals of 38 digits, which no number of rows fills.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    mark = F.md5(F.concat_ws("\x1f", *cells))
    part = [F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)").alias(n) for at, n in ((1, "_a"), (16, "_b"))]
    return df.select(*by, *part).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_a").cast("decimal(38,0)").cast("string").alias("fingerprint"),
        F.sum("_b").cast("decimal(38,0)").cast("string").alias("second_mark"),
    )


def clean_footer(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """The table with footers removed and a `changed` flag."""
    new = strip_footer(F.col("text"), pattern)
    return df.withColumn("_new", new).withColumn("changed", ~F.col("_new").eqNullSafe(F.col("text"))).withColumn(
        "text", F.col("_new")
    ).drop("_new")


def footer_changes(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Rows changed by the footer rule, per split and source."""
    return clean_footer(df, pattern).where("changed").groupBy("split", "source").agg(F.count(F.lit(1)).alias("changed"))


def stage_lineage(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per split, split shares, positives and the change against the stage before, for each curation stage."""
    out = None
    for i, (name, df) in enumerate(stages):
        row = df.agg(
            F.lit(i).alias("position"),
            F.lit(name).alias("stage"),
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS],
            F.count_if(F.col("label") == 1).alias("pos"),
            *[F.count_if((F.col("split") == s) & (F.col("label") == 1)).alias(f"pos_{s}") for s in SPLITS],
        )
        out = row if out is None else out.unionByName(row)
    # One row per stage.
    prev = F.lag("total").over(Window.partitionBy(F.lit(0)).orderBy("position"))
    return out.select(
        "*",
        (F.col("total") - prev).alias("delta"),
        *[percent(F.col(s), F.col("total")).alias(f"share_{s}") for s in SPLITS],
        *[percent(F.col(f"pos_{s}"), F.col(s), 3).alias(f"rate_{s}") for s in SPLITS],
        percent(F.col("pos"), F.col("total"), 3).alias("rate"),
    )
