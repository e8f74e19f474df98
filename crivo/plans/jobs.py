"""The two batch jobs: the leakage audit with its curation, and the domain-shift experiment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from crivo.functions.tokens import word_token_count
from crivo.operators import leakage as L, metrics as M, modeling as ML, neardup as N, profile as P, sampling as SA
from crivo.operators.selection import best_config
from crivo.operators.tfidf import AUDIT, CLASSIFIER, POOL, TfidfSpec
from crivo.session import materialise
from crivo.sources.corpus import write_table


def audit(df: DataFrame, min_sim: float = 0.7, spec: TfidfSpec = AUDIT, medians: bool = False) -> dict[str, DataFrame]:
    """All result tables of the audit. The matches are computed once and shared.

    `medians` adds the median of every row's best similarity, at the price of comparing all pairs.
    """
    matches = N.near_dup_top1(df, spec, None if medians else min_sim)
    found = matches.where(F.col("sim") >= min_sim)
    more = {"similarity_medians": N.similarity_medians(df, matches)} if medians else {}
    tokens = df.withColumn("tokens", word_token_count(F.col("text"))).drop("text")
    return {
        "overlap": L.leakage_matrix(df),
        "canonical_summary": L.canonical_summary(df),
        "canonical_members": L.canonical_members(df, drop_suffix=True),
        "source_by_split": P.source_by_split(df),
        "shortcut_sources": P.shortcut_sources(df),
        "sources_unseen_in_train": P.sources_unseen_in_train(df),
        "suspicious_pages": P.suspicious_pages(df),
        "length_describe": P.length_describe(df),
        "shortest_texts": P.shortest_texts(df),
        "truncation": P.truncation_by_class(tokens),
        "near_dup_pairs": N.attach_neighbours(df, found),
        "similarity_summary": N.similarity_summary(df, found),
        **more,
    }


def curate(df: DataFrame, threshold: float = 0.9, pattern: str | None = None, spec: TfidfSpec = AUDIT):
    """(curated table, stage counts): exact copies, near-duplicates of the test split, footers."""
    first = stage_rows(L.exact_dedup(df), "after-exact")
    dedup = df.join(first.select("doc_id"), "doc_id", "left_semi")
    second = stage_rows(N.near_dup_filter(dedup, N.near_dup_top1(dedup, spec, threshold), threshold), "after-near")
    cleaned = L.clean_footer(df.join(second.select("doc_id"), "doc_id", "left_semi"), pattern).drop("changed")
    # Cleaning changes texts, not rows.
    stages = [("raw", df), ("exact dedup", first), ("near-duplicate filter", second), ("footer cleaning", second)]
    return cleaned, L.stage_lineage(stages)


def stage_rows(df: DataFrame, name: str) -> DataFrame:
    """The rows a stage left, without their texts, written once: later stages and the counts read them from there."""
    return materialise(df.select("doc_id", "split", "label"), name)


def write_reports(tables: Mapping[str, DataFrame], base: str, fmt: str = "csv") -> dict[str, str]:
    return {name: write_table(t, f"{base.rstrip('/')}/{name}", fmt) for name, t in tables.items()}


def domain_shift_experiment(
    df: DataFrame,
    dominant: Sequence[str],
    ratios: Mapping[str, float | None],
    exposure: Mapping[str, tuple[int, float | None]],
    spec: TfidfSpec = CLASSIFIER,
    c: float = 0.1,
    seed=42,
    max_iter: int = 100,
    check_similarity: bool = True,
) -> dict[str, DataFrame]:
    """Train on the dominant sources at several ratios, choose on dev, then read test and exposure once.

    Choice and threshold come from dev alone; `exposure` has one entry per ratio name.
    """
    parted = SA.domain_partition(df, dominant)
    inside, pool = parted.where("domain = 'in'"), parted.where("domain = 'pool'")
    train, dev, test = (inside.where(F.col("split") == s) for s in ("train", "dev", "test"))
    L.assert_no_url_overlap(train, pool)
    dev_preds = materialise(ML.ratio_sweep(train, dev, ratios, spec, c, seed, max_iter), "dev_predictions")
    ranking = best_config(dev_preds, tuple(ratios))
    winner = ranking.where("winner = 1").first()["config"]
    threshold = M.best_threshold(dev_preds.where(F.col("config") == winner)).first()["threshold"]
    sets = SA.exposure_sets(pool, train, exposure, seed)
    chosen = pool.join(sets.where(F.col("set_name") == winner).select("doc_id"), "doc_id", "left_semi")
    rows = ML.one_set(train, ML.training_sets(train, ratios, seed), winner)
    both = test.withColumn("eval_set", F.lit("test")).unionByName(chosen.withColumn("eval_set", F.lit("exposure")))
    scored = materialise(ML.svm_scores(rows, both, spec, c, max_iter), "final_predictions")
    out = {
        "dev_ranking": ranking,
        "set_report": SA.set_report(sets),
        "exposure_report": SA.exposure_report(pool, sets.where(F.col("set_name") == winner)),
        "domain_shift": M.domain_shift(scored, "test", "exposure", threshold),
        "predictions": scored,
    }
    for name in ("test", "exposure"):
        part = scored.where(F.col("eval_set") == name)
        out[f"ci_{name}"] = M.bootstrap_ci(part, threshold, with_ap=True, seed=seed)
    if check_similarity:
        out["pool_max_similarity"] = N.pool_max_similarity(train, pool, POOL)
    return out
