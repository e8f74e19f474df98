"""Stored tables: versions, indexes, hash trees, kept counts, buckets; contracts and optional inputs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from crivo.functions import text as X
from crivo.functions.tokens import tokenizer_count
from crivo.operators import hashtree as H, leakage as L, masking as K, profile as P, ranking as R, selection as SE
from crivo.operators.textindex import TrigramIndex
from crivo.plans.audit_queries import FOOTER, KEPT, NORMED, TOKENS, _foot_sql, _W
from crivo.plans.model_queries import SCORED, _hash_order, scored
from crivo.plans.registry import ORACLE, query
from crivo.session import scratch
from crivo.sources import corpus as S, views as V
from crivo.sources.bucketed import write_bucketed
from crivo.sources.tokencache import TokenCounts
from crivo.sources.versions import VersionedTable

LICENCE = X.footer_pattern("Licensed", "under", "The")
NEEDLE = "Anea. eri"


def footer_rewritten(spark, sf, pattern: str) -> VersionedTable:
    """The corpus as a versioned table of several files, with footers removed from the files that have one, twice."""
    table = VersionedTable(spark, scratch(spark, "versions"))
    table.create(V.corpus_all(spark, sf).repartitionByRange(16, "doc_id"))
    clean = X.strip_footer(F.col("text"), pattern)
    for _ in range(2):
        table.rewrite(clean != F.col("text"), lambda rows: rows.withColumn("text", clean))
    return table


@query(
    "footer_rewrite",
    f"SELECT doc_id, split, source, label, md5(cleaned) AS text_md5, length(cleaned)::BIGINT AS chars FROM (SELECT *, {_foot_sql('text', 'under')} AS cleaned FROM corpus_all)",
    "corpus_all",
)
def footer_rewrite(spark, sf):
    last = footer_rewritten(spark, sf, LICENCE).read()
    return last.select("doc_id", "split", "source", "label", F.md5("text").alias("text_md5"), F.char_length("text").cast("bigint").alias("chars"))


@query(
    "footer_rewrite_versions",
    f"""SELECT version, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT version, CASE version WHEN 0 THEN text ELSE {_foot_sql('text', 'under')} END AS t
      FROM corpus_all, (VALUES (0),(1)) v(version)) GROUP BY version""",
    "corpus_all",
)
def footer_rewrite_versions(spark, sf):
    """Every version stays readable; the second run of the rule adds none."""
    table = footer_rewritten(spark, sf, LICENCE)
    out = None
    for version in table.versions():
        sizes = table.read(version).agg(F.lit(version).alias("version"), F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
        out = sizes if out is None else out.unionByName(sizes)
    return out


@query(
    "indexed_search",
    f"SELECT doc_id, split, source, label, length(text)::BIGINT AS chars FROM corpus_all WHERE contains(lower(text),'{NEEDLE.lower()}')",
    "corpus_all",
)
def indexed_search(spark, sf):
    c = V.corpus_all(spark, sf)
    hits = TrigramIndex(spark, scratch(spark, "trigrams")).build(c).search(c, NEEDLE)
    return hits.select("doc_id", "split", "source", "label", F.char_length("text").cast("bigint").alias("chars"))


@query("reconcile_by_tree", ORACLE["reconcile_versions"])
def reconcile_by_tree(spark, sf):
    c = V.corpus_all(spark, sf)
    columns = ["text", "label", "source"]
    paths = [H.write_hashed(v, scratch(spark, "hashed"), columns) for v in (c, L.clean_footer(L.exact_dedup(c), FOOTER).drop("changed"))]
    return H.reconcile_by_tree(spark, *paths, columns)


@query(
    "tree_buckets",
    f"""SELECT bucket, count(a.url) AS old_rows, count(b.url) AS new_rows FROM (SELECT *, substr(md5(url),1,2) AS bucket FROM corpus_all) a
      LEFT JOIN v2 b ON a.url=b.url GROUP BY bucket HAVING bool_or(b.url IS NULL OR a.text IS DISTINCT FROM b.text OR a.label IS DISTINCT FROM b.label OR a.source IS DISTINCT FROM b.source)""",
    "corpus_all",
    f"{NORMED}, {KEPT}, v2 AS (SELECT url, {_foot_sql('text')} AS text, label, source FROM corpus_all WHERE doc_id IN (SELECT doc_id FROM k WHERE rn=1))",
)
def tree_buckets(spark, sf):
    """The buckets in which two versions differ, found from the trees alone, with their sizes."""
    c = V.corpus_all(spark, sf)
    columns = ["text", "label", "source"]
    old, new = (H.hash_tree(v, columns) for v in (c, L.clean_footer(L.exact_dedup(c), FOOTER)))
    old, new = (S.write_table(t, scratch(spark, "tree")) for t in (old, new))
    old, new = spark.read.parquet(old), spark.read.parquet(new)
    found = H.differing(old, new)
    sides = old.where(F.col("node").isin(found)).join(new.withColumnRenamed("rows", "new_rows"), "node", "left")
    return sides.select(F.col("node").alias("bucket"), F.col("rows").alias("old_rows"), F.coalesce("new_rows", F.lit(0)).alias("new_rows"))


def _encode(texts: list[str]) -> list[list[int]]:
    """Stands for a tokenizer's batch call: words and two special tokens."""
    return [[0, *range(len(re.findall(r"\w\w+", t.lower()))), 0] for t in texts]


@query(
    "cached_token_counts",
    f"""SELECT doc_id, (len({TOKENS})+2)::BIGINT AS tokens FROM corpus_all""",
    "corpus_all",
)
def cached_token_counts(spark, sf):
    """Train texts are counted in a first run; the second counts only those of dev and test that are new."""
    c = V.corpus_all(spark, sf)
    cache = TokenCounts(spark, scratch(spark, "token-counts"), "words")
    for rows in (c.where("split = 'train'"), c):
        cache.update(rows, tokenizer_count(_encode))
    return cache.counts(c)


_SEGMENTS = rf"regexp_extract_all(text,'[{_W}]+|[^{_W}]+')"


@query(
    "mask_source_terms",
    f"""SELECT doc_id, md5(coalesce(string_agg(CASE WHEN term IS NULL THEN seg ELSE ' ' END, '' ORDER BY i),'')) AS text_md5, count(term) AS masked
      FROM (SELECT doc_id, generate_subscripts({_SEGMENTS},1) AS i, unnest({_SEGMENTS}) AS seg FROM corpus_all) LEFT JOIN giveaways ON term=lower(seg) GROUP BY doc_id""",
    "corpus_all",
    f"giveaways AS (SELECT DISTINCT term FROM ({ORACLE['source_terms'][ORACLE['source_terms'].index(') SELECT') + 2:]}))",
)
def mask_source_terms(spark, sf):
    """Texts without the terms that one source holds more than half of."""
    c = V.corpus_all(spark, sf)
    terms = P.source_terms(c).select("term")
    marked = K.mask_by_terms(c.select("doc_id", "text"), terms, mask="\x00")
    return marked.where("text <> ''").select(
        "doc_id", F.md5(F.translate("text", "\x00", " ")).alias("text_md5"), (F.length("text") - F.length(F.translate("text", "\x00", ""))).cast("bigint").alias("masked")
    )


@query("bucketed_prediction_join", "SELECT s.doc_id, s.label, round_even(s.score,6) AS score, c.source, c.split FROM s JOIN corpus_all c USING (url)", "corpus corpus_all", SCORED)
def bucketed_prediction_join(spark, sf):
    preds = scored(spark, sf).select("url", "doc_id", "label", F.bround("score", 6).alias("score"))
    names = [write_bucketed(df, "url", 16) for df in (preds, V.corpus_all(spark, sf).select("url", "source", "split"))]
    left, right = (spark.table(n) for n in names)
    return SE.prediction_join(left.hint("merge"), right).drop("url")


@query("shuffled_rows", f"SELECT doc_id, row_number() OVER (ORDER BY {_hash_order(42)}) AS position FROM corpus_all", "corpus_all")
def shuffled_rows(spark, sf):
    """Every row's place in the seeded order."""
    return R.hash_rank(V.corpus_all(spark, sf).select("doc_id"), "doc_id", 42).select("doc_id", F.col("rank").alias("position"))


@query(
    "input_optional",
    "SELECT split, count(*) AS n FROM corpus_all WHERE split<>'test' GROUP BY split",
    "corpus_all",
)
def optional_input(spark, sf):
    """Two reports that were written and one that was not, read alike."""
    c = S.require_columns(V.corpus_all(spark, sf), S.DOCUMENT_COLUMNS, "corpus").select("doc_id", "split")
    paths = {s: scratch(spark, f"report-{s}") for s in S.SPLITS}
    for split in ("train", "dev"):
        S.write_table(c.where(F.col("split") == split), paths[split])
    out = None
    for path in paths.values():
        part = S.read_optional(spark, path, c.schema, "parquet")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("split").agg(F.count("*").alias("n"))
