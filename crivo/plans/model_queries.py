"""Sampling, similarity, metric and model queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from crivo.functions.scores import argmax2, predict_at, sigmoid, softmax_positive
from crivo.operators import leakage as L, metrics as M, modeling as ML, neardup as N, sampling as SA, selection as SE
from crivo.operators import profile as P, ranking as R
from crivo.operators.relational import with_row
from crivo.operators.tfidf import AUDIT, POOL, TfidfSpec, outside_vocabularies, term_counts, tfidf_weights, vocabulary
from crivo.plans.audit_queries import DOMINANT, IN_DOMINANT, KEPT, NORMED, TOKENS, FOOTER
from crivo.plans.jobs import curate
from crivo.plans.registry import div, pct, query
from crivo.session import materialise, scratch
from crivo.sources import corpus as S, views as V

# Small ratios: the given labels hold about six negatives per positive.
RATIOS = {"natural": None, "1a4": 4.0, "1a2": 2.0}
EXPOSURE = {"natural": (1, None), "1a4": (2, 4.0), "1a2": (2, 2.0)}
THRESHOLD = 0.0
MODEL = TfidfSpec(min_df=2, max_df=0.9, max_features=20_000, low=1, high=3)


# ---- sampling

_DOM = f"d AS (SELECT *, CASE WHEN {IN_DOMINANT} THEN 'in' ELSE 'pool' END AS domain FROM corpus)"


def _hash_order(seed) -> str:
    return f"md5('{seed}:'||doc_id), doc_id"


@query("domain_partition", "SELECT domain, split, label, count(*) AS n FROM d GROUP BY ALL", "corpus_all", _DOM.replace("FROM corpus)", "FROM corpus_all)"))
def domain_partition(spark, sf):
    d = SA.domain_partition(V.corpus_all(spark, sf), DOMINANT)
    return d.groupBy("domain", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "capped_positive_sample",
    f"SELECT doc_id, source, pick FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_hash_order(42)})::INT AS pick FROM corpus WHERE label=1) WHERE pick<=2",
    "corpus",
)
def capped_positive_sample(spark, sf):
    return SA.capped_positive_sample(V.corpus(spark, sf), 2).select("doc_id", "source", "pick")


_UNDER = f"""u AS (SELECT set_name, doc_id, label FROM (
    SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)}) AS r, count(*) FILTER (label=1) OVER () AS np FROM {{t}}),
    (VALUES ('natural',NULL::DOUBLE),('1a4',4.0::DOUBLE),('1a2',2.0::DOUBLE)) v(set_name, ratio)
    WHERE label=1 OR ratio IS NULL OR r<=np*ratio)"""


@query("ratio_undersample", "SELECT * FROM u", "corpus", _UNDER.format(t="(SELECT * FROM corpus WHERE split='train')"))
def ratio_undersample(spark, sf):
    return SA.ratio_undersample(V.corpus(spark, sf).where("split = 'train'"), RATIOS)


_EXP = f"""pp AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_hash_order(42)}) AS pick FROM d WHERE domain='pool' AND label=1),
  pn AS (SELECT doc_id, row_number() OVER (ORDER BY {_hash_order(42)}) AS r FROM d WHERE domain='pool' AND label=0),
  sp AS (SELECT * FROM (VALUES ('natural',1,NULL::DOUBLE),('1a4',2,4.0::DOUBLE),('1a2',2,2.0::DOUBLE)) v(set_name, cap, ratio)),
  nat AS (SELECT count(*) FILTER (label=0)::DOUBLE/count(*) FILTER (label=1) AS nr FROM d WHERE domain='in' AND split='train'),
  ep AS (SELECT set_name, doc_id, 1 AS label FROM pp JOIN sp ON pick<=cap),
  lim AS (SELECT set_name, round_even(count(*)*coalesce(any_value(ratio), any_value(nr)),0)::BIGINT AS nn FROM ep JOIN sp USING (set_name), nat GROUP BY set_name),
  ex AS (SELECT * FROM ep UNION ALL SELECT set_name, doc_id, 0 AS label FROM pn JOIN lim ON r<=nn)"""


def _domain(spark, sf):
    d = SA.domain_partition(V.corpus(spark, sf), DOMINANT)
    return d.where("domain = 'in'"), d.where("domain = 'pool'")


@query("exposure_sets", "SELECT * FROM ex", "corpus", f"{_DOM}, {_EXP}")
def exposure_sets(spark, sf):
    inside, pool = _domain(spark, sf)
    return SA.exposure_sets(pool, inside.where("split = 'train'"), EXPOSURE)


@query(
    "exposure_report",
    "SELECT source, count(*) AS original, count(e.doc_id) AS selected FROM (SELECT * FROM d WHERE domain='pool' AND label=1) LEFT JOIN (SELECT * FROM ep WHERE set_name='1a4') e USING (doc_id) GROUP BY source",
    "corpus",
    f"{_DOM}, {_EXP}",
)
def exposure_report(spark, sf):
    inside, pool = _domain(spark, sf)
    sets = SA.exposure_sets(pool, inside.where("split = 'train'"), EXPOSURE)
    return SA.exposure_report(pool, sets.where("set_name = '1a4'"))


@query(
    "set_report",
    "SELECT set_name, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg, count(*) AS total, round_even(count(*) FILTER (label=0)::DOUBLE/count(*) FILTER (label=1),1) AS ratio FROM u GROUP BY set_name",
    "corpus",
    _UNDER.format(t="corpus"),
)
def set_report(spark, sf):
    return SA.set_report(SA.ratio_undersample(V.corpus(spark, sf), RATIOS))


@query(
    "stratified_folds",
    f"SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)})-1)%5)::INT AS fold FROM corpus",
    "corpus",
)
def stratified_folds(spark, sf):
    return SA.stratified_folds(V.corpus(spark, sf))


@query(
    "quick_sample",
    f"SELECT doc_id, split, source FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_hash_order(0)}) AS r FROM corpus_all) WHERE r<=100",
    "corpus_all",
)
def quick_sample(spark, sf):
    return SA.quick_sample(V.corpus_all(spark, sf), 100).select("doc_id", "split", "source")


@query(
    "ratio_oversample",
    f"""SELECT doc_id, label, unnest(range(1, 1+(CASE WHEN label=0 THEN 1 ELSE target//np + (r<=target-(target//np)*np)::INT END)::INT))::INT AS copy FROM (
      SELECT *, greatest(floor(nn/2.0::DOUBLE)::BIGINT, np) AS target FROM (
        SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)}) AS r,
          count(*) FILTER (label=1) OVER () AS np, count(*) FILTER (label=0) OVER () AS nn FROM corpus WHERE split='train'))""",
    "corpus",
)
def ratio_oversample(spark, sf):
    return SA.ratio_oversample(V.corpus(spark, sf).where("split = 'train'"), 2.0)


@query(
    "leave_one_source_out",
    """SELECT held_out, CASE WHEN source=held_out THEN 'test' ELSE 'train' END AS role, count(*) AS n, count(*) FILTER (label=1) AS pos
      FROM corpus_all, (SELECT DISTINCT source AS held_out FROM corpus_all) GROUP BY ALL""",
    "corpus_all",
)
def leave_one_source_out(spark, sf):
    return SA.leave_one_source_out(V.corpus_all(spark, sf))


# ---- tf-idf and similarity


def tfidf_ctes(fit: str, rows: str, min_df: int, max_df: float, cap: int) -> str:
    """Weights w(doc_id, split, term, w) with sublinear counts, the vocabulary fitted on `fit`."""
    return f"""tf AS (SELECT doc_id, split, term, count(*) AS tf FROM (SELECT doc_id, split, unnest({TOKENS}) AS term FROM {rows}) GROUP BY ALL),
    ft AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM {fit}) GROUP BY ALL),
    voc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, ln((1.0::DOUBLE+n)/(1.0::DOUBLE+count(*)))+1 AS idf
      FROM ft, (SELECT count(*) AS n FROM {fit}) GROUP BY term, n HAVING count(*)>={min_df} AND count(*)<={max_df}::DOUBLE*n ORDER BY total DESC, term LIMIT {cap}),
    w AS (SELECT doc_id, split, term, v/sqrt(sum(v*v) OVER (PARTITION BY doc_id)) AS w FROM (
      SELECT doc_id, split, tf.term, (1+ln(tf.tf::DOUBLE))*idf AS v FROM tf JOIN voc USING (term)))"""


_AUDIT = tfidf_ctes("corpus_all", "corpus_all", 2, 0.5, 200_000)
_TOP = f"""sim AS (SELECT q.doc_id, r.doc_id AS nn_doc_id, round(sum(q.w*r.w),9) AS s, any_value(r.split) AS rs FROM w q JOIN w r USING (term)
    WHERE (q.split='dev' AND r.split='train') OR (q.split='test' AND r.split IN ('train','dev')) GROUP BY 1,2),
  best AS (SELECT doc_id, nn_doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, CASE rs WHEN 'train' THEN 0 ELSE 1 END, nn_doc_id) AS r FROM sim) WHERE r=1),
  top1 AS (SELECT c.split AS query, c.doc_id, round_even(coalesce(s,0::DOUBLE),4) AS sim, coalesce(nn_doc_id, (SELECT min(doc_id) FROM corpus_all WHERE split='train')) AS nn_doc_id
    FROM corpus_all c LEFT JOIN best USING (doc_id) WHERE c.split IN ('dev','test'))"""
SIM_CTES = f"{_AUDIT}, {_TOP}"
_PAIR = """pairs AS (SELECT query, doc_id, nn_doc_id, sim, a.label, b.label AS nn_label, a.source, b.source AS nn_source, b.split AS nn_split, a.url, b.url AS nn_url,
    substr(a.text,1,200) AS text, substr(b.text,1,200) AS nn_text FROM top1 JOIN corpus_all a USING (doc_id) JOIN corpus_all b ON b.doc_id=nn_doc_id WHERE sim>=0.7)"""


@query("tfidf_vocab", "SELECT term, df, total, round_even(idf,6) AS idf FROM voc", "corpus_all", _AUDIT)
def tfidf_vocab(spark, sf):
    c = V.corpus_all(spark, sf)
    return vocabulary(c, AUDIT).select("term", "df", "total", F.bround("idf", 6).alias("idf"))


@query("tfidf_weights", "SELECT doc_id, term, round_even(w,6) AS weight FROM w", "corpus_all", _AUDIT)
def tfidf_weights_query(spark, sf):
    c = V.corpus_all(spark, sf)
    w = tfidf_weights(term_counts(c, AUDIT), vocabulary(c, AUDIT), AUDIT)
    return w.select("doc_id", "term", F.bround("weight", 6).alias("weight"))


@query("near_dup_top1", "SELECT * FROM top1", "corpus_all", SIM_CTES)
def near_dup_top1(spark, sf):
    return N.near_dup_top1(V.corpus_all(spark, sf))


@query("near_dup_pairs", "SELECT * FROM pairs", "corpus_all", f"{SIM_CTES}, {_PAIR}")
def near_dup_pairs(spark, sf):
    return N.near_dup_pairs(V.corpus_all(spark, sf), 0.7)


@query(
    "near_dup_top10",
    """SELECT query, doc_id, nn_doc_id, sim, label, nn_label, nn_split, url, nn_url FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc_id) AS r
      FROM pairs WHERE sim>=0.8) WHERE r<=10""",
    "corpus_all",
    f"{SIM_CTES}, {_PAIR}",
)
def near_dup_top10(spark, sf):
    return N.top_pairs(N.near_dup_pairs(V.corpus_all(spark, sf), 0.8), 0.8)


@query(
    "near_dup_filter",
    "SELECT doc_id, split, label, source FROM corpus_all WHERE doc_id NOT IN (SELECT doc_id FROM top1 WHERE query='test' AND sim>=0.9)",
    "corpus_all",
    SIM_CTES,
)
def near_dup_filter(spark, sf):
    c = V.corpus_all(spark, sf)
    return N.near_dup_filter(c, N.near_dup_top1(c, min_sim=0.9)).select("doc_id", "split", "label", "source")


@query(
    "filter_effect",
    """SELECT split, count(*) AS rows_before, count(*) FILTER (label=1) AS pos_before, count(*) FILTER (keep) AS rows_after, count(*) FILTER (keep AND label=1) AS pos_after
      FROM (SELECT *, doc_id NOT IN (SELECT doc_id FROM top1 WHERE query='test' AND sim>=0.9) AS keep FROM corpus_all) GROUP BY split""",
    "corpus_all",
    SIM_CTES,
)
def filter_effect(spark, sf):
    c = V.corpus_all(spark, sf)
    return N.filter_effect(c, N.near_dup_filter(c, N.near_dup_top1(c, min_sim=0.9)))


@query(
    "similarity_histogram",
    """SELECT query, bin, round_even((7000+bin*200)/10000.0::DOUBLE,2) AS lower, coalesce(n,0)::BIGINT AS n FROM (VALUES ('dev'),('test')) q(query)
      CROSS JOIN (SELECT unnest(range(15))::INT AS bin) LEFT JOIN (SELECT query, ((least(round(sim*10000)::INT,9999)-7000)//200)::INT AS bin, count(*) AS n
      FROM top1 WHERE sim>=0.7 GROUP BY 1,2) USING (query, bin)""",
    "corpus_all",
    SIM_CTES,
)
def similarity_histogram(spark, sf):
    return N.similarity_histogram(N.near_dup_top1(V.corpus_all(spark, sf), min_sim=0.7))


@query(
    "similarity_summary",
    """SELECT query, t::DOUBLE AS threshold, count(*) FILTER (sim>=t) AS pairs, count(*) FILTER (sim>=t AND a.label=1) AS positives,
      count(*) FILTER (sim>=t AND a.label IS DISTINCT FROM b.label) AS other_label, count(*) FILTER (sim>=t AND a.source<>b.source) AS other_source
      FROM (VALUES ('dev'),('test')) g(query) CROSS JOIN (VALUES (0.8::DOUBLE),(0.9::DOUBLE),(0.95::DOUBLE),(0.99::DOUBLE)) v(t) LEFT JOIN top1 USING (query)
      LEFT JOIN corpus_all a USING (doc_id) LEFT JOIN corpus_all b ON b.doc_id=nn_doc_id GROUP BY query, t""",
    "corpus_all",
    SIM_CTES,
)
def similarity_summary(spark, sf):
    c = V.corpus_all(spark, sf)
    return N.similarity_summary(c, N.near_dup_top1(c, min_sim=0.8))


@query(
    "similarity_medians",
    "SELECT query, label, count(*) AS n, round_even(quantile_cont(sim,0.5),4) AS median_sim FROM top1 JOIN corpus_all USING (doc_id) GROUP BY query, label",
    "corpus_all",
    SIM_CTES,
)
def similarity_medians(spark, sf):
    c = V.corpus_all(spark, sf)
    return N.similarity_medians(c, N.near_dup_top1(c))


@query(
    "pool_max_similarity",
    """SELECT (SELECT count(*) FROM pool) AS pool_rows, round_even(max(s),4) AS max_sim FROM (SELECT round(sum(q.w*r.w),9) AS s
      FROM w q JOIN w r USING (term) WHERE q.split='pool' AND r.split='train' GROUP BY q.doc_id, r.doc_id)""",
    "corpus_all",
    f"""{_DOM.replace("FROM corpus)", "FROM corpus_all)")}, tr AS (SELECT doc_id, text, 'train' AS split FROM d WHERE domain='in' AND split='train'), pool AS (SELECT doc_id, text, 'pool' AS split FROM d WHERE domain='pool'),
    both_sides AS (SELECT * FROM tr UNION ALL SELECT * FROM pool), """ + tfidf_ctes("tr", "both_sides", 1, 1.0, 20_000),
)
def pool_max_similarity(spark, sf):
    d = SA.domain_partition(V.corpus_all(spark, sf), DOMINANT)
    return N.pool_max_similarity(d.where("domain = 'in' AND split = 'train'"), d.where("domain = 'pool'"), POOL)


@query(
    "embedding_top1",
    """SELECT doc_id, round_even(s,4) AS sim, nn_doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, nn_doc_id) AS r FROM (
      SELECT q.doc_id, r.doc_id AS nn_doc_id, round(list_dot_product(q.v, r.v),9) AS s FROM nv q JOIN nv r ON q.split<>'train' AND r.split='train')) WHERE r=1""",
    "vectors",
    "nv AS (SELECT doc_id, split, list_transform(embedding::DOUBLE[], lambda x: x/sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))) AS v FROM vectors)",
)
def embedding_top1(spark, sf):
    v = V.vectors(spark, sf).withColumn("rank", F.lit(0))
    return N.embedding_top1(v.where("split <> 'train'"), v.where("split = 'train'"))


@query(
    "stage_lineage",
    f"""SELECT position, stage, total, train, dev, test, pos, pos_train, pos_dev, pos_test, (total - lag(total) OVER (ORDER BY position)) AS delta,
      {', '.join(pct(s, 'total') + f' AS share_{s}' for s in ('train', 'dev', 'test'))},
      {', '.join(pct(f'pos_{s}', s, 3) + f' AS rate_{s}' for s in ('train', 'dev', 'test'))}, {pct('pos', 'total', 3)} AS rate
      FROM (SELECT position, stage, count(*) AS total, {', '.join(f"count(*) FILTER (split='{s}') AS {s}" for s in ('train', 'dev', 'test'))}, count(*) FILTER (label=1) AS pos,
      {', '.join(f"count(*) FILTER (split='{s}' AND label=1) AS pos_{s}" for s in ('train', 'dev', 'test'))} FROM st GROUP BY position, stage)""",
    "corpus_all",
    f"""{NORMED}, {KEPT}, dd AS (SELECT * FROM corpus_all WHERE doc_id IN (SELECT doc_id FROM k WHERE rn=1)), {SIM_CTES.replace('corpus_all', 'dd')},
    nd AS (SELECT * FROM dd WHERE doc_id NOT IN (SELECT doc_id FROM top1 WHERE query='test' AND sim>=0.9)),
    st AS (SELECT 0 AS position, 'raw' AS stage, split, label FROM corpus_all UNION ALL SELECT 1, 'exact dedup', split, label FROM dd
      UNION ALL SELECT 2, 'near-duplicate filter', split, label FROM nd UNION ALL SELECT 3, 'footer cleaning', split, label FROM nd)""",
)
def stage_lineage(spark, sf):
    return curate(V.corpus_all(spark, sf), 0.9, FOOTER)[1]


# ---- metrics on the scores of a lexicon fitted to the train split


def _lexicon_sql(sets: str, terms: str = "TRUE") -> str:
    """Scores sc(config, doc_id, score) of lexicons fitted on `sets` (config, doc_id, label)."""
    return f"""sets AS ({sets}),
    tk AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text),'[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS term FROM corpus),
    wt AS (SELECT config, term, c1+c0 AS docs, round(10000*ln(((c1+1.0::DOUBLE)/(n1+2.0::DOUBLE))/((c0+1.0::DOUBLE)/(n0+2.0::DOUBLE))))::BIGINT AS w,
      row_number() OVER (PARTITION BY config ORDER BY c1+c0 DESC, term) AS nth
      FROM (SELECT config, term, count(*) FILTER (label=1) AS c1, count(*) FILTER (label=0) AS c0 FROM sets JOIN tk USING (doc_id) GROUP BY ALL HAVING count(*)>=5)
      JOIN (SELECT config, count(*) FILTER (label=1) AS n1, count(*) FILTER (label=0) AS n0 FROM sets GROUP BY config) USING (config)),
    sc AS (SELECT config, doc_id, sum(w)::BIGINT/10000.0::DOUBLE AS score FROM tk JOIN wt USING (term) WHERE {terms} GROUP BY ALL)"""


_SET = f"CASE WHEN {IN_DOMINANT} THEN split ELSE 'exposure' END"
_ALL_TRAIN = "SELECT 'natural' AS config, doc_id, label FROM corpus WHERE split='train'"
SCORED = f"{_lexicon_sql(_ALL_TRAIN)}, s AS (SELECT doc_id, url, source, label, split, {_SET} AS eval_set, coalesce(score,0::DOUBLE) AS score FROM corpus LEFT JOIN sc USING (doc_id))"


def scored(spark, sf):
    """Every labelled document with the score of a lexicon fitted to the train split."""
    c = V.corpus(spark, sf)
    out = ML.lexicon_scores(c, ML.lexicon(c.where("split = 'train'")))
    eval_set = F.when(F.col("source").isin(*DOMINANT), F.col("split")).otherwise("exposure")
    return out.select("doc_id", "url", "source", "label", "split", eval_set.alias("eval_set"), "score")


def _cells(pred: str) -> str:
    return (
        f"count(*) FILTER (label=1 AND {pred}) AS tp, count(*) FILTER (label=0 AND {pred}) AS fp, "
        f"count(*) FILTER (label=1 AND NOT ({pred})) AS fn, count(*) FILTER (label=0 AND NOT ({pred})) AS tn"
    )


_RATES = ", ".join(
    f"round_even({e},6) AS {n}"
    for n, e in {
        "accuracy": div("tp+tn", "tp+fp+fn+tn"),
        "precision": div("tp", "tp+fp"),
        "recall": div("tp", "tp+fn"),
        "f1": div("2*tp", "2*tp+fp+fn"),
        "fpr": div("fp", "fp+tn"),
        "pct_pred_pos": "100*" + div("tp+fp", "tp+fp+fn+tn"),
    }.items()
)


def _curve(by: str, table: str = "s") -> str:
    """Running points pt(by, score, n, pos, tp, fp, total_n, total_pos)."""
    return f"""pt AS (SELECT *, sum(pos) OVER d AS tp, sum(n-pos) OVER d AS fp, sum(n) OVER (PARTITION BY {by}) AS total_n, sum(pos) OVER (PARTITION BY {by}) AS total_pos
      FROM (SELECT {by}, score, count(*) AS n, sum(label)::BIGINT AS pos FROM {table} GROUP BY ALL) WINDOW d AS (PARTITION BY {by} ORDER BY score DESC))"""


def _ranking(by: str) -> str:
    return f"""rk AS (SELECT {by}, round_even(sum(pos::DOUBLE/total_pos*tp/(tp+fp)),6) AS ap,
      round_even(sum((n-pos)*(tp-pos/2.0::DOUBLE))/(any_value(total_n-total_pos)*any_value(total_pos)),6) AS roc_auc FROM pt GROUP BY {by})"""


@query("threshold_predict", f"SELECT doc_id, label, (score>={THRESHOLD})::INT AS pred, (score>1.0)::INT AS by_logits FROM s", "corpus", SCORED)
def threshold_predict(spark, sf):
    return scored(spark, sf).select(
        "doc_id", "label", predict_at(F.col("score"), F.lit(THRESHOLD)).alias("pred"),
        argmax2(F.lit(1.0), F.col("score") + 0.0).alias("by_logits"),
    )


@query(
    "score_to_prob",
    "SELECT doc_id, round_even(1/(1+exp(-greatest(least(score*100-60,50),-50))),9) AS p_margin, round_even(1/(1+exp(0.5::DOUBLE-score)),9) AS p_softmax FROM s",
    "corpus",
    SCORED,
)
def score_to_prob(spark, sf):
    return scored(spark, sf).select(
        "doc_id",
        F.bround(sigmoid(F.col("score") * 100 - 60), 9).alias("p_margin"),
        F.bround(softmax_positive(F.lit(0.5), F.col("score")), 9).alias("p_softmax"),
    )


@query(
    "binary_metrics",
    f"SELECT *, {_RATES} FROM (SELECT eval_set, {_cells(f'score>={THRESHOLD}')} FROM s GROUP BY eval_set)",
    "corpus",
    SCORED,
)
def binary_metrics(spark, sf):
    return M.binary_metrics(scored(spark, sf), THRESHOLD, ["eval_set"])


@query("average_precision", "SELECT eval_set, ap FROM rk", "corpus", f"{SCORED}, {_curve('eval_set')}, {_ranking('eval_set')}")
def average_precision(spark, sf):
    return M.average_precision(scored(spark, sf), ["eval_set"])


@query("roc_auc", "SELECT eval_set, roc_auc FROM rk", "corpus", f"{SCORED}, {_curve('eval_set')}, {_ranking('eval_set')}")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), ["eval_set"])


@query(
    "pr_curve",
    f"SELECT eval_set, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round_even({div('tp','tp+fp')},6) AS precision, round_even({div('tp','total_pos')},6) AS recall FROM pt",
    "corpus",
    f"{SCORED}, {_curve('eval_set')}",
)
def pr_curve(spark, sf):
    return M.pr_curve(scored(spark, sf), ["eval_set"])


@query(
    "class_report",
    f"""SELECT class, round_even(p,6) AS precision, round_even(r,6) AS recall, round_even(f,6) AS f1, support FROM (
      SELECT class, p, r, f, support FROM pc UNION ALL
      SELECT 'accuracy', acc, acc, acc, n FROM (SELECT sum(r*support)/sum(support) AS acc, sum(support)::BIGINT AS n FROM pc) UNION ALL
      SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM pc UNION ALL
      SELECT 'weighted avg', sum(p*support)/sum(support), sum(r*support)/sum(support), sum(f*support)/sum(support), sum(support)::BIGINT FROM pc)""",
    "corpus",
    f"""{SCORED}, cf AS (SELECT {_cells(f'score>={THRESHOLD}')} FROM s),
    pc AS (SELECT '0' AS class, {div('tn','tn+fn')} AS p, {div('tn','tn+fp')} AS r, {div('2*tn','2*tn+fn+fp')} AS f, tn+fp AS support FROM cf UNION ALL
      SELECT '1', {div('tp','tp+fp')}, {div('tp','tp+fn')}, {div('2*tp','2*tp+fp+fn')}, tp+fn FROM cf)""",
)
def class_report(spark, sf):
    s = scored(spark, sf)
    return M.class_report(s.withColumn("pred", predict_at(F.col("score"), F.lit(THRESHOLD))))


def _best_threshold(by: str, table: str = "s") -> str:
    return f"""q AS (SELECT {by}, unnest(quantile_cont(score, list_transform(range(1000), lambda i: (0.1::DOUBLE+i*(99.8::DOUBLE/999))/100))) AS t,
        generate_subscripts(quantile_cont(score, list_transform(range(1000), lambda i: (0.1::DOUBLE+i*(99.8::DOUBLE/999))/100)),1) AS k FROM {table} GROUP BY {by}),
      bt AS (SELECT {by}, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, k) AS r FROM (
        SELECT {by}, k, any_value(t) AS threshold, 2.0::DOUBLE*count(*) FILTER (label=1 AND score>=t)/(count(*) FILTER (label=1)+count(*) FILTER (score>=t)) AS f1
        FROM {table} JOIN q USING ({by}) GROUP BY {by}, k)) WHERE r=1)"""


@query("best_threshold", "SELECT eval_set, round_even(threshold,6) AS threshold, round_even(f1,6) AS f1 FROM bt", "corpus", f"{SCORED}, {_best_threshold('eval_set')}")
def best_threshold(spark, sf):
    return M.best_threshold(scored(spark, sf), ["eval_set"])


_REPLICATES = 2000
_TERMS = """list_reduce(list_transform(range(0, least(n, 200) + 1), lambda i: {'i': i::DOUBLE, 'p': 0::DOUBLE, 'c': 0::DOUBLE, 'j': 0::BIGINT}),
      lambda a, e: {'i': e.i, 'p': a.p * (n - e.i) / (e.i + 1) * (rare / (1 - rare)), 'c': a.c + a.p, 'j': a.j + (a.c + a.p < u)::BIGINT},
      {'i': 0::DOUBLE, 'p': pow(1 - rare, n::DOUBLE), 'c': 0::DOUBLE, 'j': 0::BIGINT}).j"""
#: Counts draws(rep, cell, n) of cells(cell, weight), split in halves from the top by seeded binomial quantiles.
_DRAWS = f"""size AS (SELECT CASE WHEN max(cell)=0 THEN 0 ELSE length(bin(max(cell))) END AS levels, sum(weight)::BIGINT AS total FROM cells),
    sh AS (SELECT lvl, cell >> (levels-lvl) AS cell, coalesce((sum(weight) FILTER ((cell >> (levels-lvl-1)) % 2 = 0))::DOUBLE/nullif(sum(weight),0),0) AS share
      FROM cells, size, (SELECT unnest(range(40))::INT AS lvl) WHERE lvl<levels GROUP BY ALL),
    tree AS (SELECT rep, 0 AS lvl, 0::BIGINT AS cell, total AS n FROM size, (SELECT unnest(range(1,{_REPLICATES + 1})) AS rep)
      UNION ALL SELECT rep, lvl+1, 2*cell+side, CASE side WHEN 0 THEN l ELSE n-l END FROM (
        SELECT *, CASE WHEN share>0.5 THEN n-d ELSE d END AS l FROM (
          SELECT *, CASE WHEN n*rare>50 THEN greatest(least(round(n*rare+sqrt(n*rare*(1-rare))*sqrt(-2*ln(u))*cos(2*pi()*u2))::BIGINT, n), 0) ELSE least({_TERMS}, n) END AS d FROM (
            SELECT *, least(share, 1-share) AS rare, (('0x'||substr(h,1,13))::BIGINT+0.5::DOUBLE)/4503599627370496::DOUBLE AS u, (('0x'||substr(h,14,13))::BIGINT+0.5::DOUBLE)/4503599627370496::DOUBLE AS u2
            FROM (SELECT tree.*, share, md5('42:'||rep||':'||tree.lvl||':'||tree.cell) AS h FROM tree JOIN sh ON sh.lvl=tree.lvl AND sh.cell=tree.cell WHERE n>0)))),
        (VALUES (0),(1)) v(side)),
    draws AS (SELECT rep, cell, n FROM tree, size WHERE lvl=levels AND n>0)"""
_BOOT = f"""cells AS (SELECT unnest([0,1,2,3])::BIGINT AS cell, unnest([tp,fn,fp,tn]) AS weight FROM (SELECT {_cells(f'score>={THRESHOLD}')} FROM e)), {_DRAWS},
    rr AS (SELECT *, {_RATES} FROM (SELECT rep, {', '.join(f'coalesce(sum(n) FILTER (cell={i}),0) AS {c}' for i, c in enumerate(('tp', 'fn', 'fp', 'tn')))} FROM draws GROUP BY rep))"""
_ENTRIES = """SELECT metric, count(*) AS replicates, round_even(quantile_cont(v,0.025),4) AS low, round_even(quantile_cont(v,0.975),4) AS high
      FROM (UNPIVOT (SELECT {cols} FROM rr WHERE {kept}) ON {cols} INTO NAME metric VALUE v) GROUP BY metric"""
_TWO_CLASSES = "tp+fn>0 AND fp+tn>0"


def _boot_sql(cols: str, ctes: str, kept: str = _TWO_CLASSES) -> str:
    return f"SELECT * FROM (WITH RECURSIVE e AS (SELECT * FROM s WHERE split='test'), {ctes} {_ENTRIES.format(cols=cols, kept=kept)})"


_ROW_DRAWS = f"""pos AS (SELECT count(*) FILTER (label=1 AND score>={THRESHOLD}) AS a, count(*) FILTER (label=1) AS b,
      count(*) FILTER (label=1)+count(*) FILTER (label=0 AND score>={THRESHOLD}) AS c, count(*) AS n FROM e),
    dr AS (SELECT rep, (('0x'||substr(md5('42:'||rep||':'||doc_id),1,15))::BIGINT % n) AS i FROM e, (SELECT unnest(range(1,{_REPLICATES + 1})) AS rep), pos)"""


@query(
    "bootstrap_ci",
    _ENTRIES.format(cols="f1, recall, precision", kept=_TWO_CLASSES),
    "corpus",
    f"""{SCORED}, e AS (SELECT * FROM s WHERE split='test'), {_ROW_DRAWS}, rr AS (SELECT *, {_RATES} FROM (SELECT rep, count(*) FILTER (i<a) AS tp,
      count(*) FILTER (i>=b AND i<c) AS fp, count(*) FILTER (i>=a AND i<b) AS fn, count(*) FILTER (i>=c) AS tn FROM dr, pos GROUP BY rep))""",
)
def bootstrap_ci(spark, sf):
    return M.bootstrap_ci(scored(spark, sf).where("split = 'test'"), THRESHOLD, _REPLICATES, key="doc_id")


@query("bootstrap_ci_kept", _boot_sql("f1, recall", _BOOT, "true"), "corpus", SCORED)
def bootstrap_ci_kept(spark, sf):
    """The variant that keeps replicates with a single class: their undefined rates count as 0."""
    ci = M.bootstrap_ci(scored(spark, sf).where("split = 'test'"), THRESHOLD, _REPLICATES, skip_degenerate=False)
    return ci.where("metric <> 'precision'")


@query(
    "bootstrap_ci_ap",
    _boot_sql(
        "f1, recall, precision, ap",
        f"""places AS (SELECT score, dense_rank() OVER (ORDER BY score DESC)-1 AS place, n, pos FROM (SELECT score, count(*) AS n, sum(label)::BIGINT AS pos FROM e GROUP BY score)),
    cells AS (SELECT 2*place AS cell, pos AS weight FROM places UNION ALL SELECT 2*place+1, n-pos FROM places), {_DRAWS},
    g AS (SELECT rep, score, sum(draws.n)::BIGINT AS n, coalesce(sum(draws.n) FILTER (cell % 2 = 0),0)::BIGINT AS pos FROM draws JOIN places ON place=cell//2 GROUP BY rep, score),
    pts AS (SELECT *, sum(pos) OVER d AS tpc, sum(n) OVER d AS nc FROM g WINDOW d AS (PARTITION BY rep ORDER BY score DESC)),
    rr AS (SELECT *, {_RATES} FROM (SELECT rep, coalesce(sum(pos) FILTER (score>={THRESHOLD}),0) AS tp, coalesce(sum(n-pos) FILTER (score>={THRESHOLD}),0) AS fp,
      coalesce(sum(pos) FILTER (score<{THRESHOLD}),0) AS fn, coalesce(sum(n-pos) FILTER (score<{THRESHOLD}),0) AS tn,
      {div('sum(pos*tpc::DOUBLE/nc)','sum(pos)')} AS ap FROM pts GROUP BY rep))""",
    ),
    "corpus",
    SCORED,
)
def bootstrap_ci_ap(spark, sf):
    return M.bootstrap_ci(scored(spark, sf).where("split = 'test'"), THRESHOLD, _REPLICATES, with_ap=True)


_NAMES = ("ap", "roc_auc", "f1", "precision", "recall")


def _pivot(p: str, s: str) -> str:
    return ", ".join(f"max({m}) FILTER (eval_set='{s}') AS {p}_{m}" for m in _NAMES)


@query(
    "domain_shift",
    f"""SELECT *, {', '.join(f'round_even(exp_{m}-in_{m},6) AS delta_{m}' for m in _NAMES)},
      CASE WHEN exp_ap>=0.70 THEN 'threshold shift' ELSE 'ranking degraded' END AS verdict FROM (SELECT {_pivot('in', 'test')}, {_pivot('exp', 'exposure')} FROM mm),
      (SELECT round_even(threshold,6) AS exp_best_threshold, round_even(f1,6) AS exp_best_f1 FROM bt WHERE eval_set='exposure')""",
    "corpus",
    f"""{SCORED}, {_curve('eval_set')}, {_ranking('eval_set')}, {_best_threshold('eval_set')},
    mm AS (SELECT * FROM rk JOIN (SELECT *, {_RATES} FROM (SELECT eval_set, {_cells(f'score>={THRESHOLD}')} FROM s GROUP BY eval_set)) USING (eval_set))""",
)
def domain_shift(spark, sf):
    return M.domain_shift(scored(spark, sf), "test", "exposure", THRESHOLD)


_BY_SOURCE = "round_even(" + div("tp", "tp+fn") + ",6) AS recall, round_even(" + div("fp", "fp+tn") + ",6) AS fpr"


@query(
    "metrics_by_source",
    f"""SELECT kind, name, tp, fp, fn, tn, {_BY_SOURCE} FROM (SELECT 'source' AS kind, source AS name, {_cells(f'score>={THRESHOLD}')} FROM s GROUP BY source
      UNION ALL SELECT 'group', CASE WHEN {IN_DOMINANT} THEN 'dominant' ELSE 'other' END, {_cells(f'score>={THRESHOLD}')} FROM s GROUP BY 2)""",
    "corpus",
    SCORED,
)
def metrics_by_source(spark, sf):
    return M.metrics_by_source(scored(spark, sf), THRESHOLD, DOMINANT)


_SETS = f"SELECT set_name AS config, doc_id, label FROM u"
_DEV = "cg AS (SELECT config, doc_id, label, coalesce(score,0::DOUBLE) AS score FROM (SELECT DISTINCT config FROM sets) CROSS JOIN (SELECT doc_id, label FROM corpus WHERE split='dev') LEFT JOIN sc USING (config, doc_id))"
_TRAIN_SETS = _UNDER.format(t="tr").replace("u AS (", "tr AS (SELECT * FROM corpus WHERE split='train'), u AS (", 1)


def _fits(spark, sf, rows=None):
    """Every row of `rows` (dev, unless given) scored by one lexicon per training ratio: config is the ratio."""
    c = V.corpus(spark, sf)
    train = c.where("split = 'train'")
    rows = c.where("split = 'dev'") if rows is None else rows(c)
    sets = materialise(ML.training_sets(train, RATIOS), "training_sets")
    out = None
    for name in RATIOS:
        fitted = ML.lexicon(ML.one_set(train, sets, name))
        part = ML.lexicon_scores(rows, fitted).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "model_comparison",
    """SELECT model, eval_set, ap, f1, precision, recall, round_even(ap-max(ap) FILTER (eval_set='dev') OVER (PARTITION BY model),6) AS delta_ap,
      round_even(f1-max(f1) FILTER (eval_set='dev') OVER (PARTITION BY model),6) AS delta_f1 FROM mm""",
    "corpus",
    f"""{_TRAIN_SETS}, {_lexicon_sql(_SETS)},
    md AS (SELECT config AS model, {_SET} AS eval_set, doc_id, label, coalesce(score,0::DOUBLE) AS score
      FROM (SELECT DISTINCT config FROM sets) CROSS JOIN corpus LEFT JOIN sc USING (config, doc_id)),
    {_curve('model, eval_set', 'md')}, {_ranking('model, eval_set')},
    mm AS (SELECT * FROM rk JOIN (SELECT *, {_RATES} FROM (SELECT model, eval_set, {_cells(f'score>={THRESHOLD}')} FROM md GROUP BY model, eval_set)) USING (model, eval_set))""",
)
def model_comparison(spark, sf):
    eval_set = F.when(F.col("source").isin(*DOMINANT), F.col("split")).otherwise("exposure")
    preds = _fits(spark, sf, lambda c: c.withColumn("eval_set", eval_set))
    return SE.model_comparison(preds.withColumnRenamed("config", "model"), THRESHOLD)


@query(
    "best_config",
    "SELECT *, (row_number() OVER (ORDER BY ap DESC, config='1a2', config='1a4', config)=1)::INT AS winner FROM rk",
    "corpus",
    f"{_TRAIN_SETS}, {_lexicon_sql(_SETS)}, {_DEV}, {_curve('config', 'cg')}, {_ranking('config')}",
)
def best_config(spark, sf):
    return SE.best_config(_fits(spark, sf), ("natural", "1a4", "1a2"))


_SIZES = ", ".join(f"({k})" for k in ML.GRID_FEATURES)


@query(
    "grid_winner",
    """SELECT ratio, max_features, dev_f1, tp, fp, fn, tn, (row_number() OVER (ORDER BY dev_f1 DESC, ratio)=1)::INT AS winner FROM (
      SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY dev_f1 DESC, max_features) AS r FROM gr) WHERE r=1""",
    "corpus",
    f"""{_TRAIN_SETS}, {_lexicon_sql(_SETS)},
    sk AS (SELECT config, k, doc_id, sum(w)::BIGINT/10000.0::DOUBLE AS score FROM tk JOIN wt USING (term), (VALUES {_SIZES}) z(k) WHERE nth<=k GROUP BY ALL),
    gr AS (SELECT config AS ratio, k::INT AS max_features, round_even({div('2*tp','2*tp+fp+fn')},6) AS dev_f1, tp, fp, fn, tn FROM (
      SELECT config, k, {_cells(f'score>={THRESHOLD}')} FROM (SELECT config, k, label, coalesce(score,0::DOUBLE) AS score
        FROM (SELECT DISTINCT config FROM sets) CROSS JOIN (VALUES {_SIZES}) z(k) CROSS JOIN (SELECT doc_id, label FROM corpus WHERE split='dev')
        LEFT JOIN sk USING (config, k, doc_id)) GROUP BY config, k))""",
)
def grid_winner(spark, sf):
    c = V.corpus(spark, sf)
    train, names = c.where("split = 'train'"), list(RATIOS)
    sets = materialise(ML.training_sets(train, RATIOS), "training_sets")
    lexicons = ML.lexicon_grid(train, sets, names, ML.GRID_FEATURES)
    preds = ML.lexicon_grid_scores(c.where("split = 'dev'"), lexicons, names, ML.GRID_FEATURES)
    m = M.binary_metrics(preds, THRESHOLD, ["config", "max_features"])
    return SE.grid_winner(m.select(F.col("config").alias("ratio"), "max_features", F.col("f1").alias("dev_f1"), "tp", "fp", "fn", "tn"))


_PARTS = f"""SELECT p AS config, doc_id, label FROM (SELECT *, row_number() OVER (ORDER BY {_hash_order(42)}) AS r, count(*) OVER () AS n FROM corpus WHERE split='train'),
  (VALUES (1),(2),(3)) v(p) WHERE 3*r<=p*n"""


@query(
    "learning_curve",
    f"""SELECT config::DOUBLE AS epoch, eval_loss, eval_f1, (row_number() OVER (ORDER BY eval_f1 DESC, config)=1)::INT AS best FROM (
      SELECT config, round_even(avg(abs(label-(score>={THRESHOLD})::INT)),6) AS eval_loss,
        round_even({div(f'2*count(*) FILTER (label=1 AND score>={THRESHOLD})', f'count(*) FILTER (label=1)+count(*) FILTER (score>={THRESHOLD})')},6) AS eval_f1 FROM cg GROUP BY config)""",
    "corpus",
    f"{_lexicon_sql(_PARTS)}, {_DEV}",
)
def learning_curve(spark, sf):
    """Fits on one, two and three thirds of the train split; their dev results go through a written training state."""
    c = V.corpus(spark, sf)
    train, dev = c.where("split = 'train'"), c.where("split = 'dev'")
    ranked = R.hash_rank(train.select("doc_id"), "doc_id", 42)
    ranked = materialise(with_row(ranked, ranked.agg(F.count(F.lit(1)).alias("n"))), "ranked")
    log = None
    for part in (1, 2, 3):
        rows = train.join(ranked.where(3 * F.col("rank") <= part * F.col("n")).select("doc_id"), "doc_id", "left_semi")
        preds = ML.lexicon_scores(dev, ML.lexicon(rows)).withColumn("pred", predict_at(F.col("score"), F.lit(THRESHOLD)))
        loss = F.bround(F.avg(F.abs(F.col("label") - F.col("pred"))), 6).alias("eval_loss")
        m = M.binary_metrics(preds, THRESHOLD, ["split"]).join(preds.groupBy("split").agg(loss), "split")
        row = m.select(F.lit(float(part)).alias("epoch"), F.lit(None).cast("double").alias("loss"), "eval_loss", F.col("f1").alias("eval_f1"))
        log = row if log is None else log.unionByName(row)
    entries = F.sort_array(F.collect_list(F.struct("epoch", "loss", "eval_loss", "eval_f1"))).alias("log_history")
    path = scratch(spark, "training-state")
    log.agg(F.lit("part-3").alias("best_model_checkpoint"), entries).coalesce(1).write.json(path)
    return SE.learning_curve(S.read_training_state(spark, path))


@query(
    "prediction_join",
    f"SELECT s.doc_id, s.label, round_even(s.score,6) AS score, c.source, c.split FROM s JOIN corpus_all c USING (url)",
    "corpus corpus_all",
    SCORED,
)
def prediction_join(spark, sf):
    preds = scored(spark, sf).select("url", "doc_id", "label", F.bround("score", 6).alias("score"))
    return SE.prediction_join(preds, V.corpus_all(spark, sf)).drop("url")


@query("prediction_coverage", "SELECT count(s.url) AS predictions, count(c.url) AS rows, count(*) FILTER (s.url=c.url) AS matched FROM s FULL JOIN corpus_all c ON s.url=c.url", "corpus corpus_all", SCORED)
def prediction_coverage(spark, sf):
    return SE.prediction_coverage(scored(spark, sf), V.corpus_all(spark, sf))


# ---- models (no SQL: iterative fits)


def _splits(spark, sf):
    c = V.corpus(spark, sf)
    return c.where("split = 'train'"), c.where("split = 'dev'"), c.where("split = 'test'")


_SEEDS = (42, 43, 44)
_SEEDED = " UNION ALL ".join(
    f"""SELECT 'seed_variance' AS model, 'seed {k}' AS set_name, doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash_order(k)}) AS r,
      count(*) FILTER (label=1) OVER () AS np FROM tr) WHERE label=1 OR r<=2*np"""
    for k in _SEEDS
)
_PROBE = f"""SELECT 'embedding_probe' AS model, 'fold ' || ((row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)})-1)%5) AS set_name, doc_id, label FROM vectors WHERE split='train'"""


@query(
    "model_inputs",
    f"""SELECT model, set_name, count(*) AS n, count(*) FILTER (label=1) AS pos, sum(doc_id)::BIGINT AS members,
      round_even(CASE WHEN model='weighted_logreg' THEN {div('count(*) FILTER (label=0)', 'count(*) FILTER (label=1)')} ELSE 1 END,6) AS weight FROM (
        SELECT 'svm_scores' AS model, 'train' AS set_name, doc_id, label FROM tr UNION ALL SELECT 'weighted_logreg', 'train', doc_id, label FROM tr
        UNION ALL SELECT 'ratio_sweep', set_name, doc_id, label FROM u UNION ALL {_SEEDED} UNION ALL {_PROBE}
        UNION ALL SELECT 'final_eval', CASE split WHEN 'train' THEN 'train' ELSE 'test' END, doc_id, label FROM d WHERE domain='in' AND split<>'dev'
        UNION ALL SELECT 'final_eval', 'exposure', doc_id, label FROM ex WHERE set_name='1a4') GROUP BY model, set_name""",
    "corpus vectors",
    f"{_TRAIN_SETS}, {_DOM}, {_EXP}",
)
def model_inputs(spark, sf):
    """What every model query is fitted on or judged by, apart from the solver: members of its sets and folds, class weights."""
    train, _, _ = _splits(spark, sf)
    inside, pool = _domain(spark, sf)
    exposure = SA.exposure_sets(pool, inside.where("split = 'train'"), EXPOSURE).where("set_name = '1a4'")
    probe = SA.stratified_folds(V.vectors(spark, sf).where("split = 'train'"))

    def part(model, name, rows):
        name = name if isinstance(name, Column) else F.lit(name)
        return rows.select(F.lit(model).alias("model"), name.alias("set_name"), F.col("doc_id").cast("bigint").alias("doc_id"), "label")

    ratios = SA.ratio_undersample(train, RATIOS)
    parts = [
        part("svm_scores", "train", train), part("weighted_logreg", "train", train), part("ratio_sweep", F.col("set_name"), ratios),
        *[part("seed_variance", f"seed {k}", SA.ratio_undersample(train, {"s": 2.0}, k)) for k in _SEEDS],
        part("embedding_probe", F.concat(F.lit("fold "), F.col("fold").cast("string")), probe),
        part("final_eval", "train", inside.where("split = 'train'")), part("final_eval", "test", inside.where("split = 'test'")),
        part("final_eval", "exposure", exposure),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    sizes = rows.groupBy("model", "set_name").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.sum("doc_id").alias("members"))
    weight = ML.class_weights(train).agg(F.max(F.when(F.col("label") == 1, F.col("weight"))).alias("_w"))
    sizes = with_row(sizes, weight)
    return sizes.withColumn("weight", F.when(F.col("model") == "weighted_logreg", F.bround("_w", 6)).otherwise(1.0)).drop("_w")


@query("svm_scores")
def svm_scores(spark, sf):
    train, dev, test = _splits(spark, sf)
    return ML.svm_scores(train, dev.unionByName(test), MODEL)


@query("top_coefficients")
def top_coefficients(spark, sf):
    train, _, _ = _splits(spark, sf)
    vec = ML.fit_vectorizer(train, MODEL)
    rows = vec.transform(train).select("label", "features")
    n = train.count()
    model = ML.svm(n, 0.1).fit(ML.pack(rows, n))
    return ML.top_coefficients(model, vec, spark, 30, P.source_terms(V.corpus_all(spark, sf)).select("term", "source"))


@query("ratio_sweep")
def ratio_sweep(spark, sf):
    train, dev, _ = _splits(spark, sf)
    return SE.best_config(ML.ratio_sweep(train, dev, RATIOS, MODEL), tuple(RATIOS))


@query("grid_search")
def grid_search(spark, sf):
    """Every ratio, feature count, C and fold of the experiment: 360 fits and 12 refits."""
    train, dev, _ = _splits(spark, sf)
    grid, _ = ML.grid_search(train, dev, RATIOS, ML.GRID_FEATURES, spec=MODEL)
    return SE.grid_winner(grid)


_FOLD_SPEC = TfidfSpec(min_df=2, max_df=0.9, max_features=1_000, low=1, high=2)


@query(
    "fold_vocabularies",
    f"""SELECT fold, term, df, total, round_even(idf,6) AS idf FROM (
      SELECT fold, term, df, total, ln((1.0::DOUBLE+n)/(1.0::DOUBLE+df))+1 AS idf, row_number() OVER (PARTITION BY fold ORDER BY total DESC, term) AS r FROM (
        SELECT g.fold, term, count(*) AS df, sum(tf)::BIGINT AS total, any_value(n) AS n FROM gt JOIN ft USING (doc_id) JOIN (SELECT unnest(range(5))::INT AS fold) g ON g.fold<>ft.fold
          JOIN (SELECT g2.fold, count(*) AS n FROM ft, (SELECT unnest(range(5))::INT AS fold) g2 WHERE ft.fold<>g2.fold GROUP BY ALL) z ON z.fold=g.fold GROUP BY g.fold, term)
      WHERE df>=2 AND df<=0.9::DOUBLE*n) WHERE r<=1000""",
    "corpus",
    f"""ft AS (SELECT doc_id, text, ((row_number() OVER (PARTITION BY label ORDER BY {_hash_order(42)})-1)%5)::INT AS fold FROM corpus WHERE split='train'),
    gw AS (SELECT doc_id, {TOKENS} AS ws FROM ft),
    gt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]))) AS term FROM gw) GROUP BY ALL)""",
)
def fold_vocabularies(spark, sf):
    """What the vectoriser of each cross-validation fold knows: terms of the rows outside the fold."""
    train, _, _ = _splits(spark, sf)
    rows = materialise(train.join(SA.stratified_folds(train).select("doc_id", "fold"), "doc_id"), "fold-rows")
    out = None
    for fold, part in enumerate(outside_vocabularies(rows, _FOLD_SPEC, "fold", range(5))):
        part = part.select(F.lit(fold).alias("fold"), "term", "df", "total", F.bround("idf", 6).alias("idf"))
        out = part if out is None else out.unionByName(part)
    return out


@query("grid_search_in_fold")
def grid_search_in_fold(spark, sf):
    """The natural ratio with the vectoriser fitted inside every fold: 2 feature counts, 2 values of C, 5 folds."""
    train, dev, _ = _splits(spark, sf)
    grid, _ = ML.grid_search_in_fold(train, dev, (1_000, 10_000), (0.1, 10.0), spec=MODEL, max_iter=10)
    return SE.grid_winner(grid)


@query("final_eval")
def final_eval(spark, sf):
    inside, pool = _domain(spark, sf)
    exposure = SA.exposure_sets(pool, inside.where("split = 'train'"), EXPOSURE).where("set_name = '1a4'")
    sets = {"test": inside.where("split = 'test'"), "exposure": pool.join(exposure.select("doc_id"), "doc_id", "left_semi")}
    return ML.final_eval(inside.where("split = 'train'"), sets, MODEL, 2.0)


@query("weighted_logreg")
def weighted_logreg(spark, sf):
    train, dev, _ = _splits(spark, sf)
    return ML.weighted_logreg(train, dev, MODEL)


@query("embedding_probe")
def embedding_probe(spark, sf):
    v = V.vectors(spark, sf)
    return ML.embedding_probe(v.where("split = 'train'"), v.where("split <> 'train'"))


_KNOWN = 20_000


@query(
    "batch_predict",
    "SELECT doc_id, coalesce(score,0::DOUBLE) AS prediction FROM corpus LEFT JOIN sc USING (doc_id)",
    "corpus",
    _lexicon_sql(_ALL_TRAIN, f"nth<={_KNOWN}"),
)
def batch_predict(spark, sf):
    """A fitted model applied in batches: the weights of the train split's lexicon, sent to each worker once."""
    c = V.corpus(spark, sf)
    fitted = ML.lexicon(c.where("split = 'train'"), max_features=_KNOWN).toArrow()  # _KNOWN rows at most
    shared = spark.sparkContext.broadcast((fitted["term"].to_pylist(), fitted["weight"].to_pylist()))

    def make():
        import re

        place = {t: i for i, t in enumerate(shared.value[0])}
        weight = np.array([*shared.value[1], 0], np.int64)  # the last one stands for unknown terms
        word = re.compile(r"\w\w+")

        def predict(prompts: np.ndarray) -> np.ndarray:
            known = [list({place.get(w, -1) for w in word.findall(t.lower())}) or [-1] for t in prompts]
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            total = np.add.reduceat(weight[np.concatenate(known)], np.cumsum(sizes) - sizes)
            return total / 10000.0

        return predict

    prompts = c.select("doc_id", F.concat(F.lit(ML.QUERY_PREFIX), "text").alias("prompt"))
    return ML.batch_predict(prompts, make, [F.col("prompt")], DoubleType()).select("doc_id", "prediction")


@query("seed_variance")
def seed_variance(spark, sf):
    train, dev, _ = _splits(spark, sf)
    return ML.seed_variance(train, dev, 2.0, _SEEDS, MODEL)
