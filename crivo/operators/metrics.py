"""Imbalance-aware evaluation of scored predictions: (label, score), optionally grouped by evaluation set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crivo.functions.scores import binomial_draw, hash_number, predict_at, ratio, uniforms
from crivo.operators.ranking import running_points, score_points
from crivo.operators.relational import with_row
from crivo.session import materialise

ROUND = 6
PLACE_BITS = 10  # a block holds 2 ** PLACE_BITS distinct scores
TASK_DRAWS = 1 << 20  # counts of a task that adds up running totals
BROADCAST_LEVELS = 12  # a level of the draw's tree has at most 2 ** level nodes


def _r(c: Column, digits: int = ROUND) -> Column:
    return F.bround(c, digits)


def confusion(preds: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn per group in one pass."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return preds.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def rates(cells: DataFrame, digits: int = ROUND) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR and the share predicted positive; an empty base gives 0, never NULL."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return cells.withColumns(
        {
            "accuracy": _r(ratio(tp + tn, n), digits),
            "precision": _r(ratio(tp, tp + fp), digits),
            "recall": _r(ratio(tp, tp + fn), digits),
            "f1": _r(ratio(2 * tp, 2 * tp + fp + fn), digits),
            "fpr": _r(ratio(fp, fp + tn), digits),
            "pct_pred_pos": _r(100 * ratio(tp + fp, n), digits),
        }
    )


def binary_metrics(preds: DataFrame, threshold: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells and rates at a fixed cut of the score."""
    return rates(confusion(preds.withColumn("pred", predict_at(F.col("score"), F.lit(threshold))), by))


def pr_curve(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, tied scores as one point."""
    pts = running_points(score_points(preds, by), by)
    return pts.select(
        *by,
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        _r(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        _r(ratio(F.col("tp"), F.col("total_pos"))).alias("recall"),
    )


def ranking_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum over distinct scores) and ROC-AUC (ties count half), both in one pass."""
    pts = running_points(score_points(preds, by), by)
    neg = F.col("n") - F.col("pos")
    total_neg = F.col("total_n") - F.col("total_pos")
    return pts.groupBy(*by).agg(
        _r(F.sum(ratio(F.col("pos"), F.col("total_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp")))).alias("ap"),
        _r(
            ratio(
                F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)),
                F.max(total_neg.cast("double") * F.col("total_pos")),
            )
        ).alias("roc_auc"),
    )


def average_precision(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(preds, by).select(*by, "ap")


def roc_auc(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(preds, by).select(*by, "roc_auc")


def threshold_candidates(
    preds: DataFrame, by: Sequence[str] = (), low: float = 0.1, high: float = 99.9, count: int = 1000
) -> DataFrame:
    """F1 at `count` evenly spaced score percentiles (linear interpolation), without a rows x thresholds join.

    The score at ascending index i lies in exactly one score point, and that point already knows how many rows and
    positives lie at or above it. Each point emits the percentiles whose lower index falls on it.
    """
    by = list(by)
    pts = running_points(score_points(preds, by), by)
    step = (high - low) / (count - 1)
    last = (F.col("total_n") - 1).cast("double")
    first_index = F.col("total_n") - F.col("tp") - F.col("fp")
    final_index = first_index + F.col("n") - 1
    # A margin of one on each side absorbs rounding; the exact test follows.
    k_from = F.floor((first_index * 100.0 / F.greatest(last, F.lit(1.0)) - low) / step) - 1
    k_to = F.ceil(((final_index + 1) * 100.0 / F.greatest(last, F.lit(1.0)) - low) / step) + 1
    k_from = F.greatest(k_from, F.lit(0)).cast("int")
    k_to = F.least(k_to, F.lit(count - 1)).cast("int")
    ks = F.when(k_from <= k_to, F.sequence(k_from, F.greatest(k_from, k_to))).otherwise(
        F.array().cast("array<int>")
    )
    spot = (F.lit(low) + F.col("k") * F.lit(step)) / 100.0 * last
    out = (
        pts.withColumn("first_index", first_index)
        .withColumn("final_index", final_index)
        .withColumn("k", F.explode(ks))
        .withColumn("spot", spot)
        .where((F.floor("spot") >= F.col("first_index")) & (F.floor("spot") <= F.col("final_index")))
    )
    upper = F.when(F.floor("spot") < F.col("final_index"), F.col("score")).otherwise(
        F.coalesce("next_score", "score")
    )
    out = out.withColumn("threshold", F.col("score") + (upper - F.col("score")) * (F.col("spot") - F.floor("spot")))
    at = F.col("threshold") <= F.col("score")
    tp = F.when(at, F.col("tp")).otherwise(F.col("tp") - F.col("pos"))
    fp = F.when(at, F.col("fp")).otherwise(F.col("fp") - (F.col("n") - F.col("pos")))
    return (
        out.withColumn("tp_at", tp)
        .withColumn("fp_at", fp)
        .select(
            *by,
            "k",
            "threshold",
            F.col("tp_at").alias("tp"),
            F.col("fp_at").alias("fp"),
            (F.col("total_pos") - F.col("tp_at")).alias("fn"),
            ratio(2 * F.col("tp_at"), F.col("tp_at") + F.col("fp_at") + F.col("total_pos")).alias("f1"),
        )
    )


def best_threshold(preds: DataFrame, by: Sequence[str] = (), **grid) -> DataFrame:
    """The first percentile threshold with the highest F1."""
    cand = threshold_candidates(preds, by, **grid)
    best = cand.groupBy(*by).agg(
        F.min(F.struct((-F.col("f1")).alias("o"), "k", "threshold", "f1")).alias("b")
    )
    return best.select(*by, _r(F.col("b.threshold")).alias("threshold"), _r(F.col("b.f1")).alias("f1"))


def metrics_at(preds: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates per group at that group's own threshold. `thresholds` has one row per evaluation set."""
    joined = preds.join(F.broadcast(thresholds.select(*by, "threshold")), list(by))
    return rates(confusion(joined.withColumn("pred", predict_at(F.col("score"), F.col("threshold"))), by))


def class_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means."""
    cells = confusion(preds)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def row(name: str, t, p_den, r_den):
        p, r = ratio(t, p_den), ratio(t, r_den)
        f1 = ratio(2 * t, p_den + r_den)
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), r_den.alias("support")
        )

    two = cells.select(row("0", tn, tn + fn, tn + fp).alias("a"), row("1", tp, tp + fp, tp + fn).alias("b"))
    n = F.col("a.support") + F.col("b.support")

    def mean(name, weight_a, weight_b, base):
        def m(f):
            return ratio(F.col(f"a.{f}") * weight_a + F.col(f"b.{f}") * weight_b, base)

        return F.struct(
            F.lit(name).alias("class"),
            m("precision").alias("precision"),
            m("recall").alias("recall"),
            m("f1").alias("f1"),
            n.alias("support"),
        )

    acc = ratio(F.col("a.recall") * F.col("a.support") + F.col("b.recall") * F.col("b.support"), n)
    accuracy = F.struct(
        F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support")
    )
    one = F.lit(1.0)
    rows = F.array(
        F.col("a"),
        F.col("b"),
        accuracy,
        mean("macro avg", one, one, F.lit(2.0)),
        mean("weighted avg", F.col("a.support"), F.col("b.support"), n),
    )
    out = two.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("class", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def multinomial_draws(cells: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, cell, n): per replicate, how often each cell is drawn when all rows are drawn with replacement.

    `cells` (cell, weight) numbers the cells from 0 and says how many rows each holds. The counts come down a binary tree:
    the rows of a node that go to its left half are a binomial draw with the half's share of the node, seeded by
    replicate, level and node. So the work is cells times replicates, however many rows there are. Counts of 0 are left out.
    """
    sides = F.array(F.struct((F.col("node") * 2).alias("cell"), F.col("left").alias("n")), F.struct((F.col("node") * 2 + 1).alias("cell"), (F.col("n") - F.col("left")).alias("n")))
    return paired_draws(cells, replicates, seed).select("replicate", F.explode(sides).alias("s")).select("replicate", "s.cell", "s.n").where("n > 0")


def paired_draws(cells: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, node, n, left): the same draws, a row for the cells 2 * node and 2 * node + 1 together; `left` of its n are the former's."""
    last, total = cells.agg(F.max("cell"), F.sum("weight")).first()
    levels = max(1, int(last or 0).bit_length())
    state = cells.sparkSession.range(1, replicates + 1).select(F.col("id").alias("replicate"), F.lit(0).cast("bigint").alias("cell"), F.lit(total or 0).cast("bigint").alias("n"))
    for level in range(levels):
        half = F.shiftright("cell", levels - level - 1)
        left = F.sum(F.when(half % 2 == 0, F.col("weight")).otherwise(0)).cast("double")
        shares = cells.groupBy(F.shiftright("cell", levels - level).alias("cell")).agg(F.coalesce(F.try_divide(left, F.sum("weight")), F.lit(0.0)).alias("share"))
        state = state.where("n > 0")
        if level:
            state = state.join(F.broadcast(shares) if level <= BROADCAST_LEVELS else shares, "cell")  # 2 ** level rows
        else:
            state = with_row(state, shares.select("share"))
        u, u2 = uniforms(seed, F.col("replicate"), level, F.col("cell"))
        state = state.withColumn("left", binomial_draw(F.col("n"), F.col("share"), u, u2))
        if level < levels - 1:
            sides = F.array(F.struct((F.col("cell") * 2).alias("cell"), F.col("left").alias("n")), F.struct((F.col("cell") * 2 + 1).alias("cell"), (F.col("n") - F.col("left")).alias("n")))
            state = state.select("replicate", F.explode(sides).alias("s")).select("replicate", "s.cell", "s.n")
    return state.select("replicate", F.col("cell").alias("node"), "n", "left")


def row_draws(preds: DataFrame, threshold: float, key: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Confusion cells of each replicate, every one of its n rows drawn: draw (replicate, row) picks index md5(seed:replicate:row) mod n.

    The rows are thought of as laid out by cell, so a draw is a comparison with three running totals, and the draws of a
    task fold to one row per replicate before the shuffle. Keys are dealt in turn to a task per core: a task's work is its
    share of the rows times the replicates.
    """
    total = confusion(preds.withColumn("pred", predict_at(F.col("score"), F.lit(threshold))))
    keys = preds.select(F.col(key).cast("string").alias("_key")).repartition(preds.sparkSession.sparkContext.defaultParallelism)
    draws = keys.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    idx = F.pmod(hash_number(seed, F.col("replicate"), F.col("_key")), F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))
    drawn = with_row(draws, total).withColumn("i", idx)
    a, b, c = F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") + F.col("fp")
    return drawn.groupBy("replicate").agg(
        F.count_if(F.col("i") < a).alias("tp"),
        F.count_if((F.col("i") >= b) & (F.col("i") < c)).alias("fp"),
        F.count_if((F.col("i") >= a) & (F.col("i") < b)).alias("fn"),
        F.count_if(F.col("i") >= c).alias("tn"),
    )


def bootstrap_replicates(preds: DataFrame, threshold: float, replicates: int = 2000, seed: int = 42, with_ap: bool = False) -> DataFrame:
    """Metrics of each bootstrap replicate: as many rows as there are, drawn with replacement.

    Rows that agree in what a metric sees are one cell: the four cells of the confusion matrix, or with AP the distinct
    (score, label). Only counts per cell are drawn, never rows.
    """
    if not with_ap:
        names = ("tp", "fn", "fp", "tn")
        whole = confusion(preds.withColumn("pred", predict_at(F.col("score"), F.lit(threshold))))
        entries = F.array(*[F.struct(F.lit(i).cast("bigint").alias("cell"), F.col(c).alias("weight")) for i, c in enumerate(names)])
        drawn = multinomial_draws(whole.select(F.explode(entries).alias("e")).select("e.*"), replicates, seed)
        return rates(drawn.groupBy("replicate").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(names)]))
    points = score_points(preds)
    ranked = running_points(points.select("score", F.lit(1).alias("n"), F.lit(0).alias("pos")))  # fp counts the scores down to this one
    ranked = materialise(points.join(ranked.select("score", (F.col("fp") - 1).alias("place")), "score"), "bootstrap-cells")
    cells = ranked.select(F.explode(F.array(
        F.struct((F.col("place") * 2).alias("cell"), F.col("pos").alias("weight")), F.struct((F.col("place") * 2 + 1).alias("cell"), (F.col("n") - F.col("pos")).alias("weight"))
    )).alias("e")).select("e.*")
    # A draw of both cells of a score is one row already, so nothing is grouped: (replicate, place, n, pos).
    sample = paired_draws(cells, replicates, seed).select("replicate", F.col("node").alias("place"), "n", F.col("left").alias("pos"))
    sample = materialise(sample.withColumn("block", F.shiftright("place", PLACE_BITS)), "bootstrap-sample")
    tasks = max(sample.sparkSession.sparkContext.defaultParallelism, -(-sample.count() // TASK_DRAWS))
    sums = materialise(sample.groupBy("replicate", "block").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos")), "bootstrap-blocks")
    before = Window.partitionBy("replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("replicate", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_pos")])
    # The running totals of a replicate start in every block of places with the totals of the blocks before it.
    keys = ("replicate", "block")
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = sample.repartition(tasks, *keys).select(*keys, "place", "n", "pos", F.sum("n").over(upto).alias("n_upto"), F.sum("pos").over(upto).alias("pos_upto"))
    run = with_row(run.join(starts.repartition(tasks, *keys), [*keys]), ranked.agg(F.count_if(F.col("score") >= threshold).alias("hits")))
    hit = F.col("place") < F.col("hits")  # places go down the scores
    neg = F.col("n") - F.col("pos")
    out = run.groupBy("replicate").agg(
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp_hit"),
        F.coalesce(F.sum(F.when(hit, neg)), F.lit(0)).alias("fp_hit"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~hit, neg)), F.lit(0)).alias("tn"),
        ratio(F.sum(F.col("pos") * ratio(F.col("_pos") + F.col("pos_upto"), F.col("_n") + F.col("n_upto"))), F.sum("pos")).alias("ap"),
    )
    out = out.withColumnsRenamed({"tp_hit": "tp", "fp_hit": "fp"})
    return rates(out)


def bootstrap_ci(
    preds: DataFrame,
    threshold: float,
    replicates: int = 2000,
    seed: int = 42,
    level: float = 0.95,
    with_ap: bool = False,
    skip_degenerate: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Percentile interval of each metric. `skip_degenerate` leaves out replicates with a single class.

    With `key` every row of every replicate is drawn on its own, see `row_draws`; without it only counts per cell are.
    """
    if key is not None and with_ap:
        raise ValueError("average precision draws counts per score: give no key")
    if key is not None:
        reps = rates(row_draws(preds, threshold, key, replicates, seed))
    else:
        reps = bootstrap_replicates(preds, threshold, replicates, seed, with_ap)
    if skip_degenerate:
        reps = reps.where("tp + fn > 0 AND fp + tn > 0")
    names = ["f1", "recall", "precision"] + (["ap"] if with_ap else [])
    tail = (1 - level) / 2
    entry = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]))
    return (
        reps.select(entry.alias("e"))
        .groupBy(F.col("e.metric").alias("metric"))
        .agg(
            F.count(F.lit(1)).alias("replicates"),
            _r(F.percentile("e.value", F.lit(tail)), 4).alias("low"),
            _r(F.percentile("e.value", F.lit(1 - tail)), 4).alias("high"),
        )
    )


def metrics_by_source(preds: DataFrame, threshold: float, dominant: Sequence[str] = (), digits: int = ROUND) -> DataFrame:
    """Recall and FPR, never F1, by source and by group (dominant sources / the others)."""
    p = preds.withColumn("pred", predict_at(F.col("score"), F.lit(threshold)))
    cells = confusion(p, ["source"]).withColumnRenamed("source", "name")
    group = F.when(F.col("name").isin(*dominant), "dominant").otherwise("other") if dominant else F.lit("all")
    grouped = cells.groupBy(group.alias("name")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    per_source = cells.withColumn("kind", F.lit("source"))
    grouped = grouped.withColumn("kind", F.lit("group"))
    both = per_source.unionByName(grouped)
    return rates(both, digits).select("kind", "name", "tp", "fp", "fn", "tn", "recall", "fpr")


def domain_shift(
    preds: DataFrame, in_domain: str, exposure: str, threshold: float, robust_ap: float = 0.70, set_col: str = "eval_set"
) -> DataFrame:
    """One row: both sets at the same threshold, deltas, the best F1 the exposure set allows, and a verdict on AP."""
    sets = preds.where(F.col(set_col).isin(in_domain, exposure))
    base = binary_metrics(sets, threshold, [set_col]).join(ranking_metrics(sets, [set_col]), set_col)
    best = best_threshold(sets.where(F.col(set_col) == exposure), [set_col])
    names = ["ap", "roc_auc", "f1", "precision", "recall"]
    wide = base.agg(
        *[F.max(F.when(F.col(set_col) == in_domain, F.col(m))).alias(f"in_{m}") for m in names],
        *[F.max(F.when(F.col(set_col) == exposure, F.col(m))).alias(f"exp_{m}") for m in names],
    ).withColumn(set_col, F.lit(exposure))
    # Both sides have one row.
    out = wide.join(
        F.broadcast(best.select(set_col, F.col("threshold").alias("exp_best_threshold"), F.col("f1").alias("exp_best_f1"))),
        set_col,
    )
    return out.drop(set_col).withColumns(
        {
            **{f"delta_{m}": _r(F.col(f"exp_{m}") - F.col(f"in_{m}")) for m in names},
            "verdict": F.when(F.col("exp_ap") >= robust_ap, "threshold shift").otherwise("ranking degraded"),
        }
    )
