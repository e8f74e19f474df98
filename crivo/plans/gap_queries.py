"""Figures beside the histograms, pages, sinks, masked scores, folds and held-out sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.functions import text as X
from crivo.operators import leakage as L, metrics as M, modeling as ML, profile as P, sampling as SA
from crivo.plans.audit_queries import CANON_AGG, FOOTER, MASKED, RANK, _ESTC, _estimated, _foot_sql, _mask_sql
from crivo.plans.model_queries import SCORED, THRESHOLD, _ALL_TRAIN, _RATES, _best_threshold, _cells, _hash_order, _lexicon_sql, scored
from crivo.plans.registry import div, pct, query
from crivo.session import materialise, scratch
from crivo.sources import views as V


@query(
    "canonical_split_counts",
    f"SELECT splits, count(*) AS groups FROM (SELECT string_agg(DISTINCT split,'+' ORDER BY split) AS splits FROM web GROUP BY {CANON_AGG} HAVING count(*)>1) GROUP BY splits",
    "web",
)
def canonical_split_counts(spark, sf):
    return L.canonical_split_counts(V.web(spark, sf), drop_suffix=True)


@query(
    "length_stats",
    "SELECT label, count(*) AS n, floor(quantile_cont(chars::DOUBLE,0.5))::BIGINT AS median, floor(quantile_cont(chars::DOUBLE,0.75))::BIGINT AS q75, max(chars)::BIGINT AS max FROM c GROUP BY label",
    "corpus_all",
    "c AS (SELECT label, length(text) AS chars FROM corpus_all)",
)
def length_stats(spark, sf):
    return P.length_stats(V.corpus_all(spark, sf).select("label", F.char_length("text").alias("chars")), "chars")


@query(
    "token_stats",
    f"SELECT label, count(*) AS n, floor(quantile_cont(tokens::DOUBLE,0.5))::BIGINT AS median, count(*) FILTER (tokens>512) AS truncated, {pct('count(*) FILTER (tokens>512)','count(*)',1)} AS pct FROM c GROUP BY label",
    "corpus_all",
    _ESTC,
)
def token_stats(spark, sf):
    return P.token_stats(_estimated(V.corpus_all(spark, sf)))


@query(
    "sorted_page",
    "SELECT doc_id, split, source, label, length(text)::BIGINT AS chars FROM corpus_all ORDER BY label DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50",
    "corpus_all",
)
def sorted_page(spark, sf):
    rows = V.corpus_all(spark, sf).select("doc_id", "split", "source", "label", F.char_length("text").cast("bigint").alias("chars"))
    return P.sorted_page(rows, "label", descending=True, page=2)


@query(
    "search_after",
    f"""SELECT doc_id, split, source, label, url, length(text)::BIGINT AS chars, substr(text,1,320) AS excerpt FROM corpus_all
      WHERE contains(lower(text),'ing') AND ({RANK}>1 OR ({RANK}=1 AND doc_id>40)) ORDER BY {RANK}, doc_id LIMIT 25""",
    "corpus_all",
)
def search_after(spark, sf):
    return P.search_after(V.corpus_all(spark, sf), ("dev", 40), q="ing")


@query(
    "footer_changes",
    f"SELECT split, source, count(*) AS changed FROM corpus_all WHERE {_foot_sql('text')}<>text GROUP BY split, source",
    "corpus_all",
)
def footer_changes(spark, sf):
    return L.footer_changes(V.corpus_all(spark, sf), FOOTER)


_UNDERSAMPLED = f"""SELECT set_name, doc_id FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)}) AS r,
  count(*) FILTER (label=1) OVER () AS np FROM corpus WHERE split='train'), (VALUES ('1a4',4),('1a2',2)) v(set_name, ratio) WHERE label=1 OR r<=np*ratio"""


@query(
    "set_sinks",
    f"SELECT set_name, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({_UNDERSAMPLED}) JOIN corpus USING (doc_id) GROUP BY ALL",
    "corpus",
)
def set_sinks(spark, sf):
    train = V.corpus(spark, sf).where("split = 'train'")
    sets = SA.ratio_undersample(train, {"1a4": 4.0, "1a2": 2.0})
    path = SA.write_sets(sets, train, scratch(spark, "sets"))
    back = spark.read.parquet(path)
    return back.groupBy("set_name", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


def _masked_tokens(sql: str) -> str:
    """The same lexicon, but scoring texts whose terms are masked."""
    masked = f"unnest(list_distinct(regexp_extract_all(lower({_mask_sql(_mask_sql('text'))}),'[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS term FROM corpus)"
    return sql + f""", mk AS (SELECT doc_id, {masked},
    ms AS (SELECT doc_id, sum(w)::BIGINT/10000.0::DOUBLE AS score FROM mk JOIN wt USING (term) GROUP BY ALL)"""


@query(
    "masked_scores",
    f"""SELECT split, count(*) AS n, count(*) FILTER (coalesce(a.score,0)<>coalesce(b.score,0)) AS changed,
      count(*) FILTER ((coalesce(a.score,0)>={THRESHOLD})<>(coalesce(b.score,0)>={THRESHOLD})) AS flipped,
      round_even(avg(coalesce(b.score,0::DOUBLE)-coalesce(a.score,0::DOUBLE)),6) AS mean_change
      FROM corpus LEFT JOIN sc a USING (doc_id) LEFT JOIN ms b USING (doc_id) GROUP BY split""",
    "corpus",
    _masked_tokens(_lexicon_sql(_ALL_TRAIN)),
)
def masked_scores(spark, sf):
    """Scores before and after give-away terms are masked, under one lexicon."""
    c = V.corpus(spark, sf)
    weights = materialise(ML.lexicon(c.where("split = 'train'")), "lexicon")
    before = ML.lexicon_scores(c, weights).select("doc_id", "split", "score")
    after = ML.lexicon_scores(c.withColumn("text", X.mask_terms(F.col("text"), MASKED)), weights)
    both = before.join(after.select("doc_id", F.col("score").alias("masked")), "doc_id")
    flip = (F.col("score") >= THRESHOLD) != (F.col("masked") >= THRESHOLD)
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") != F.col("masked")).alias("changed"),
        F.count_if(flip).alias("flipped"), F.bround(F.avg(F.col("masked") - F.col("score")), 6).alias("mean_change"),
    )


@query(
    "oversampled_folds",
    f"""SELECT fold, role, label, (CASE WHEN role='train' AND label=1 THEN greatest(nn//2, np) ELSE CASE label WHEN 1 THEN np ELSE nn END END)::BIGINT AS n, CASE label WHEN 1 THEN np ELSE nn END AS docs FROM (
      SELECT g.fold::INT AS fold, role, count(*) FILTER (label=1) AS np, count(*) FILTER (label=0) AS nn FROM f, (SELECT unnest(range(5)) AS fold) g, (VALUES ('train'),('valid')) r(role)
      WHERE (f.fold=g.fold)=(role='valid') GROUP BY ALL), (VALUES (0),(1)) l(label)""",
    "corpus",
    f"f AS (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)})-1)%5)::INT AS fold FROM corpus WHERE split='train')",
)
def oversampled_folds(spark, sf):
    rows = SA.oversampled_folds(V.corpus(spark, sf).where("split = 'train'"), 2.0)
    return rows.groupBy("fold", "role", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(
    "held_out_source_recall",
    f"SELECT config AS held_out, tp, fp, fn, tn, round_even({div('tp','tp+fn')},6) AS recall, round_even({div('fp','fp+tn')},6) AS fpr FROM (SELECT config, {_cells(f'score>={THRESHOLD}')} FROM ho GROUP BY config)",
    "corpus",
    _lexicon_sql("SELECT h AS config, doc_id, label FROM corpus, (SELECT DISTINCT source AS h FROM corpus) WHERE source<>h")
    + ", ho AS (SELECT c.source AS config, c.label, coalesce(sc.score,0::DOUBLE) AS score FROM corpus c LEFT JOIN sc ON sc.doc_id=c.doc_id AND sc.config=c.source)",
)
def held_out_source_recall(spark, sf):
    """For every source: a lexicon fitted to all other sources, judged on that one."""
    m = M.binary_metrics(ML.held_out_scores(V.corpus(spark, sf)), THRESHOLD, ["source"])
    return m.select(F.col("source").alias("held_out"), "tp", "fp", "fn", "tn", "recall", "fpr")


@query(
    "metrics_at_best",
    f"SELECT eval_set, tp, fp, fn, tn, {_RATES} FROM (SELECT eval_set, {_cells('score>=round_even(threshold,6)')} FROM s JOIN bt USING (eval_set) GROUP BY eval_set)",
    "corpus",
    f"{SCORED}, {_best_threshold('eval_set')}",
)
def metrics_at_best(spark, sf):
    """Each evaluation set at the threshold that is best for it."""
    s = scored(spark, sf)
    return M.metrics_at(s, M.best_threshold(s, ["eval_set"]), ["eval_set"])
