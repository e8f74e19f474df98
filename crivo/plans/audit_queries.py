"""Load, text, url, leakage and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.functions import text as X, tokens as K
from crivo.functions.scores import l2_normalize
from crivo.operators import leakage as L, profile as P
from crivo.plans.registry import pct, query
from crivo.session import scratch
from crivo.sources import corpus as S, views as V

DOMINANT = tuple(f"src{i}" for i in range(10))
IN_DOMINANT = "source IN (" + ",".join(f"'{s}'" for s in DOMINANT) + ")"
TERMS = ("the", "license", "all rights reserved", "ing", "queeau", "@")
MASKED = ("the", "license", "licensed")
STOPS = ("the", "and", "of", "in", "le", "la", "der", "el")
PATTERNS = {"licence": r"(Licensed|licensed) under", "mail": r"[a-z0-9.]+@[a-z]+\.", "rights": "All rights reserved"}
FOOTER = X.footer_pattern("Licensed", "Version", "The")
SPAM = {"prefixes": ("m.", "blog."), "hosts": ("free-bets.example.com",)}

# The SQL states its patterns itself, so that a wrong one in the library shows.
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NORM = f"trim(regexp_replace(text,'{WS}+',' ','g'))"
TOKENS = r"regexp_extract_all(lower(text),'[\p{L}\p{N}_]{2,}')"
EST = "floor(length(text)/4.0::DOUBLE+2)::INT"
RANK = "CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END"
NORMED = f"h AS (SELECT doc_id, split, label, source, md5({NORM}) AS hash, {RANK} AS rk FROM corpus_all)"
KEPT = (
    "k AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY rk, doc_id) AS rn, "
    "count(*) OVER (PARTITION BY hash) AS copies, "
    "first_value(doc_id) OVER (PARTITION BY hash ORDER BY rk, doc_id) AS kept_doc_id, "
    "first_value(split) OVER (PARTITION BY hash ORDER BY rk, doc_id) AS kept_split FROM h)"
)


# ---- load and write


@query(
    "corpus_load",
    "SELECT doc_id, url, md5(text) AS text_md5, label, source, split FROM corpus_all",
    "corpus_all",
)
def corpus_load(spark, sf):
    """The documents, written as one csv folder per split and read back through the reader."""
    c = V.corpus_all(spark, sf)
    raw = c.select("doc_id", "url", F.col("text").alias("processed_text"), "label", F.col("source").alias("portal"), "split")
    base = scratch(spark, "corpus")
    paths = {s: S.write_table(raw.where(F.col("split") == s).drop("split"), f"{base}/{s}", "csv") for s in S.SPLITS}
    back = S.read_corpus(spark, paths, key="doc_id")
    return back.select("doc_id", "url", F.md5("text").alias("text_md5"), "label", "source", "split")


@query("sink_roundtrip", "SELECT split, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM corpus_all GROUP BY ALL", "corpus_all")
def sink_roundtrip(spark, sf):
    path = scratch(spark, "sink")
    df = V.corpus_all(spark, sf)
    S.write_table(df, path, partition_by=["split"])
    back = spark.read.schema(df.schema).parquet(path)
    return back.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")
    )


@query(
    "table_fingerprint",
    "SELECT split, count(*) AS rows, sum(('0x'||substr(m,1,15))::HUGEINT)::VARCHAR AS fingerprint, sum(('0x'||substr(m,16,15))::HUGEINT)::VARCHAR AS second_mark "
    "FROM (SELECT split, md5(concat_ws(chr(31), url, text, coalesce(label::VARCHAR, chr(0)), source)) AS m FROM corpus_all) GROUP BY split",
    "corpus_all",
)
def table_fingerprint(spark, sf):
    return L.table_fingerprint(V.corpus_all(spark, sf), ["url", "text", "label", "source"])


# ---- text functions


@query("text_normalize", f"SELECT doc_id, md5({NORM}) AS norm_md5, length({NORM}) AS chars FROM documents")
def text_normalize(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", X.normalize_space(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("norm_md5"), F.char_length("t").cast("bigint").alias("chars"))


@query(
    "content_hashes",
    f"SELECT doc_id, md5(text) AS raw, md5({NORM}) AS norm, md5(lower({NORM})) AS folded FROM documents",
)
def content_hashes(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", X.raw_hash(t).alias("raw"), X.norm_hash(t).alias("norm"), X.folded_hash(t).alias("folded")
    )


_W = r"\p{L}\p{N}_"
_G = rf"{WS}*"
def _foot_sql(expr: str, credit: str = "Version") -> str:
    """The footer rule without lookahead: keep the later section if there is one, else cut to the end."""
    start = rf"(?s){_G}Licensed{_G}[{_W}]*?{_G}{credit}"
    kept = rf"regexp_replace({expr},'{start}(?:[^{_W}].*?|)({_G}The(?:[^{_W}].*|))$','\1')"
    cut = rf"regexp_replace({kept},'{start}(?:[^{_W}].*|)$','')"
    return rf"regexp_replace({cut},'{WS}+$','')"


@query(
    "strip_footer",
    f"SELECT doc_id, md5(cleaned) AS text_md5, (cleaned<>text)::INT AS changed FROM (SELECT doc_id, text, {_foot_sql('text')} AS cleaned FROM documents)",
)
def strip_footer(spark, sf):
    cleaned = X.strip_footer(F.col("text"), FOOTER)
    return V.table(spark, sf, "documents").select(
        "doc_id", F.md5(cleaned).alias("text_md5"), (cleaned != F.col("text")).cast("int").alias("changed")
    )


LINK_SQL = r"(^|[^\p{L}\p{N}_])(?:https?://|www\.|bit\.ly/|t\.co/)[^\t-\r\x1c-\x1f\x85\p{Z}]*"
@query(
    "compose_text",
    rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(concat_ws(' ', source||' www.'||source||'.org/x', text),'{LINK_SQL}','\1','g'),'{WS}+',' ','g'))) AS text_md5 FROM documents",
)
def compose_text(spark, sf):
    title = F.concat("source", F.lit(" www."), "source", F.lit(".org/x"))
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.compose_text(title, F.col("text"))).alias("text_md5"))


_STOP_SQL = ",".join(f"'{s}'" for s in STOPS)
@query(
    "heavy_normalize",
    f"""SELECT doc_id, count(term) AS tokens, md5(coalesce(string_agg(term,' ' ORDER BY pos),'')) AS text_md5 FROM (
      SELECT d.doc_id, t.pos, CASE WHEN t.term IN ({_STOP_SQL}) THEN NULL ELSE t.term END AS term FROM documents d LEFT JOIN (
        SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks,1) AS pos FROM (
          SELECT doc_id, regexp_extract_all(strip_accents(lower(text)),'[{_W}]{{2,}}') AS toks FROM documents)) t
      USING (doc_id)) GROUP BY doc_id""",
)
def heavy_normalize(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", X.heavy_tokens(F.col("text"), STOPS).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("text_md5"))


@query("tokenize", f"SELECT doc_id, len({TOKENS})::INT AS n_tokens, md5(array_to_string({TOKENS},' ')) AS tokens_md5 FROM documents")
def tokenize(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", X.word_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "ngram_counts",
    f"""SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
      SELECT doc_id, unnest([a, a||' '||b, a||' '||b||' '||c]) AS gram FROM (
        SELECT doc_id, tok AS a, lead(tok) OVER w AS b, lead(tok,2) OVER w AS c FROM (
          SELECT doc_id, unnest(t) AS tok, generate_subscripts(t,1) AS pos FROM (SELECT doc_id, {TOKENS} AS t FROM documents))
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos))) WHERE gram IS NOT NULL GROUP BY gram""",
)
def ngram_counts(spark, sf):
    from crivo.operators.tfidf import TfidfSpec, term_counts

    counts = term_counts(V.table(spark, sf, "documents"), TfidfSpec(low=1, high=3)).where("term IS NOT NULL")
    return (
        counts.groupBy(F.col("term").alias("gram"))
        .agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))
    )


@query("token_counts", f"SELECT doc_id, (len({TOKENS})+2)::INT AS tokens, {EST} AS estimated FROM documents")
def token_counts(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id",
        K.word_token_count(F.col("text")).alias("tokens"),
        K.estimated_tokens(F.char_length("text")).alias("estimated"),
    )


@query(
    "head_tail_truncate",
    f"""SELECT doc_id, md5(array_to_string(CASE WHEN len(t)>62 THEN list_concat(t[1:16], t[-46:]) ELSE t END,' ')) AS kept_md5,
      (least(len(t),62)+2)::INT AS attended, (62-least(len(t),62))::INT AS padded, md5(array_to_string(t[1:64],' ')) AS head_md5
      FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
)
def head_tail_truncate(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", X.word_tokens(F.col("text")).alias("t"))
    ids = F.transform("t", lambda w: F.char_length(w))
    enc = d.withColumn("enc", K.encode_fixed(ids, 64, 16, 101, 102, 0))
    return enc.select(
        "doc_id",
        F.md5(F.array_join(K.head_tail_truncate(F.col("t"), 64, 16), " ")).alias("kept_md5"),
        F.aggregate("enc.attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
        F.size(F.filter("enc.attention_mask", lambda x: x == 0)).alias("padded"),
        F.md5(F.array_join(K.head_truncate(F.col("t"), 64), " ")).alias("head_md5"),
    )


_TERM_RE = "|".join(sorted(MASKED, key=lambda t: (-len(t), t)))
def _mask_sql(expr: str) -> str:
    return rf"regexp_replace({expr},'(?i)(^|[^{_W}])(?:{_TERM_RE})($|[^{_W}])','\1 \2','g')"


@query("mask_terms", f"SELECT doc_id, md5({_mask_sql(_mask_sql('text'))}) AS text_md5 FROM documents")
def mask_terms(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.mask_terms(F.col("text"), MASKED)).alias("text_md5"))


@query(
    "embedding_normalize",
    """SELECT vec_id, round_even(sum(x/n)::DOUBLE, 6) AS total, round_even(max(x/n), 6) AS highest, round_even(sum((x/n)*(x/n)), 6) AS sq FROM (
      SELECT vec_id, x, sqrt(sum(x*x) OVER (PARTITION BY vec_id)) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings))
      GROUP BY vec_id""",
)
def embedding_normalize(spark, sf):
    v = V.table(spark, sf, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    zero = F.lit(0.0)
    return v.select(
        "vec_id",
        F.bround(F.aggregate("v", zero, lambda a, x: a + x), 6).alias("total"),
        F.bround(F.array_max("v"), 6).alias("highest"),
        F.bround(F.aggregate("v", zero, lambda a, x: a + x * x), 6).alias("sq"),
    )


# ---- urls

_URL = rf"regexp_replace(regexp_replace(url,'^{WS}+|{WS}+$','','g'),'[\t\r\n]','','g')"
_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
HOST = f"lower(regexp_extract({_URL},'{_PARTS}',1))"
PATH = f"regexp_extract({_URL},'{_PARTS}',2)"
CANON = rf"regexp_replace({HOST},'^www\.','')||lower(regexp_replace({PATH},'/+$',''))"
CANON_AGG = rf"regexp_replace({HOST},'^www\.','')||regexp_replace(lower(regexp_replace({PATH},'/+$','')),'-[0-9]{{1,2}}$','')"


def _members_sql(canon: str) -> str:
    return f"""SELECT canon, n, splits, labels, doc_id, url, url_split, url_label FROM (
      SELECT {canon} AS canon, doc_id, url, split AS url_split, label AS url_label FROM web) JOIN (
      SELECT {canon} AS canon, count(*) AS n, string_agg(DISTINCT split,'+' ORDER BY split) AS splits,
        string_agg(DISTINCT label::VARCHAR,'+' ORDER BY label::VARCHAR) AS labels FROM web GROUP BY 1 HAVING count(*)>1) USING (canon)"""


@query("canonical_urls_basic", _members_sql(CANON), "web")
def canonical_urls_basic(spark, sf):
    return L.canonical_members(V.web(spark, sf))


@query("canonical_urls_aggressive", _members_sql(CANON_AGG), "web")
def canonical_urls_aggressive(spark, sf):
    return L.canonical_members(V.web(spark, sf), drop_suffix=True)


def _summary_sql(mode: str, canon: str) -> str:
    return f"""SELECT '{mode}' AS mode, count(*) AS groups, count(*) FILTER (s>1) AS cross_split, count(*) FILTER (s=1) AS intra_split,
      count(*) FILTER (l>1) AS label_conflict FROM (SELECT count(DISTINCT split) AS s, count(DISTINCT label) AS l FROM web GROUP BY {canon} HAVING count(*)>1)"""


@query("canonical_url_summary", f"{_summary_sql('basic', CANON)} UNION ALL {_summary_sql('aggressive', CANON_AGG)}", "web")
def canonical_url_summary(spark, sf):
    return L.canonical_summary(V.web(spark, sf))


_SUSP = f"(starts_with({HOST},'m.') OR starts_with({HOST},'blog.') OR {HOST}='free-bets.example.com' OR {PATH} IN ('','/'))"
@query("suspicious_pages", f"SELECT split, label, source, url FROM web WHERE {_SUSP}", "web")
def suspicious_pages(spark, sf):
    return P.suspicious_pages(V.web(spark, sf), **SPAM)


@query(
    "suspicious_crosstab",
    "SELECT source, " + ", ".join(f"count(*) FILTER (split='{s}' AND label={y}) AS {s}_{y}" for s in S.SPLITS for y in (0, 1))
    + f" FROM web WHERE {_SUSP} GROUP BY source",
    "web",
)
def suspicious_crosstab(spark, sf):
    return P.suspicious_crosstab(V.web(spark, sf), **SPAM)


# ---- leakage


@query("exact_dedup", "SELECT doc_id, split, label, source FROM k WHERE rn=1", "corpus_all", f"{NORMED}, {KEPT}")
def exact_dedup(spark, sf):
    return L.exact_dedup(V.corpus_all(spark, sf)).select("doc_id", "split", "label", "source")


@query(
    "exact_dedup_removed",
    "SELECT doc_id, split, label, source, hash, kept_doc_id, kept_split FROM k WHERE rn>1",
    "corpus_all",
    f"{NORMED}, {KEPT}",
)
def exact_dedup_removed(spark, sf):
    return L.exact_dedup_removed(V.corpus_all(spark, sf)).select(
        "doc_id", "split", "label", "source", "hash", "kept_doc_id", "kept_split"
    )


_PAIRS = "p(split_a, split_b) AS (VALUES ('train','dev'),('train','test'),('dev','test'))"


def _common(level: str, key: str) -> str:
    return f"SELECT DISTINCT '{level}' AS level, split, {key} AS v FROM corpus_all"


_LEVELS = "lv AS (" + " UNION ALL ".join(
    [_common("url", "md5(url)"), _common("raw", "md5(text)"), _common("norm", f"md5({NORM})"), _common("lower", f"md5(lower({NORM}))")]
) + ")"
_MATRIX = """m AS (SELECT l.level, p.split_a, p.split_b, count(b.v) AS common FROM p CROSS JOIN (SELECT DISTINCT level FROM lv) l
  LEFT JOIN lv a ON a.level=l.level AND a.split=p.split_a LEFT JOIN lv b ON b.level=l.level AND b.split=p.split_b AND b.v=a.v GROUP BY ALL)"""


@query("leakage_matrix", "SELECT level, split_a, split_b, common FROM m", "corpus_all", f"{_PAIRS}, {_LEVELS}, {_MATRIX}")
def leakage_matrix(spark, sf):
    return L.leakage_matrix(V.corpus_all(spark, sf))


_OVERLAP = "o AS (SELECT split_a, split_b, sum(common) FILTER (level='norm')::BIGINT AS texts, sum(common) FILTER (level='url')::BIGINT AS urls FROM m GROUP BY ALL)"


@query("split_overlap", "SELECT * FROM o", "corpus_all", f"{_PAIRS}, {_LEVELS}, {_MATRIX}, {_OVERLAP}")
def split_overlap(spark, sf):
    return L.split_overlap(V.corpus_all(spark, sf))


_INTRA = f"i AS (SELECT split, (count(*)-count(DISTINCT md5({NORM})))::BIGINT AS duplicates FROM corpus_all GROUP BY split)"


@query("intra_split_dups", "SELECT split, duplicates FROM i", "corpus_all", _INTRA)
def intra_split_dups(spark, sf):
    return L.intra_split_dups(V.corpus_all(spark, sf))


@query(
    "leakage_guard",
    "SELECT * FROM o WHERE texts>0 OR urls>0 UNION ALL SELECT split, split, duplicates, 0::BIGINT FROM i WHERE duplicates>0",
    "corpus_all",
    f"{_PAIRS}, {_LEVELS}, {_MATRIX}, {_OVERLAP}, {_INTRA}",
)
def leakage_guard(spark, sf):
    return L.leakage_guard(V.corpus_all(spark, sf))


@query(
    "pool_url_overlap",
    f"""SELECT count(*) AS common_urls FROM (SELECT DISTINCT md5(text) AS u FROM corpus_all WHERE {IN_DOMINANT} AND split='train') a
      JOIN (SELECT DISTINCT md5(text) AS u FROM corpus_all WHERE NOT {IN_DOMINANT}) b USING (u)""",
    "corpus_all",
)
def pool_url_overlap(spark, sf):
    # The text digest stands in for the url, which is unique by construction here.
    c = V.corpus_all(spark, sf).select("source", "split", F.md5("text").alias("url"))
    inside = F.col("source").isin(*DOMINANT)
    return L.url_overlap(c.where(inside & (F.col("split") == "train")), c.where(~inside))


@query(
    "integrity_audit",
    """SELECT split, count(*) AS rows, count(*)-count(url) AS null_url, count(*)-count(text) AS null_text, count(*)-count(label) AS null_label,
      count(*)-count(source) AS null_source, count(*)-count(DISTINCT md5(text)) AS dup_urls,
      (count(*)-count(DISTINCT (md5(text), text, label, source)))::BIGINT AS dup_rows FROM corpus_all GROUP BY split""",
    "corpus_all",
)
def integrity_audit(spark, sf):
    # The text digest stands in for the url, so that repeats exist.
    return L.integrity_audit(V.corpus_all(spark, sf).withColumn("url", F.md5("text")))


_NORM_A, _NORM_B = (NORM.replace("(text,", f"({t}.text,") for t in ("a", "b"))
@query(
    "reconcile_versions",
    f"""SELECT count(a.url) AS old_rows, count(b.url) AS new_rows, count(*) FILTER (a.url IS NOT NULL AND b.url IS NOT NULL) AS matched,
      count(*) FILTER (b.url IS NULL) AS only_old, count(*) FILTER (a.url IS NULL) AS only_new,
      count(*) FILTER (a.url=b.url AND a.text IS DISTINCT FROM b.text) AS diff_text,
      count(*) FILTER (a.url=b.url AND a.label IS DISTINCT FROM b.label) AS diff_label,
      count(*) FILTER (a.url=b.url AND a.source IS DISTINCT FROM b.source) AS diff_source,
      {pct(f"count(*) FILTER (a.url=b.url AND {_NORM_A} = {_NORM_B})", "count(*) FILTER (a.url=b.url)", 1)} AS text_equal_pct
      FROM corpus_all a FULL JOIN v2 b ON a.url=b.url""",
    "corpus_all",
    f"{NORMED}, {KEPT}, v2 AS (SELECT url, {_foot_sql('text')} AS text, label, source FROM corpus_all WHERE doc_id IN (SELECT doc_id FROM k WHERE rn=1))",
)
def reconcile_versions(spark, sf):
    c = V.corpus_all(spark, sf)
    curated = L.clean_footer(L.exact_dedup(c), FOOTER)
    return L.reconcile_versions(c, curated, ["text", "label", "source"])


@query(
    "dataset_diff",
    f"""SELECT 'removed' AS change, split, label, count(*) AS n FROM h JOIN k USING (doc_id, split, label) WHERE k.rn>1 GROUP BY ALL""",
    "corpus_all",
    f"{NORMED}, {KEPT}".replace("label, source, md5", "coalesce(label,-1) AS label, source, md5"),
)
def dataset_diff(spark, sf):
    c = V.corpus_all(spark, sf).withColumn("label", F.coalesce("label", F.lit(-1)))
    return L.dataset_diff(c, L.exact_dedup(c))


# ---- profile

_POS = "coalesce(sum(label),0)::BIGINT"
_NEG = "count(*) FILTER (label=0)"


@query("class_distribution", "SELECT split, label, count(*) AS n FROM corpus GROUP BY ALL", "corpus")
def class_distribution(spark, sf):
    return P.class_distribution(V.corpus(spark, sf))


@query(
    "class_weight",
    "SELECT count(*) FILTER (label=0) AS n_neg, count(*) FILTER (label=1) AS n_pos, round_even(count(*) FILTER (label=0)::DOUBLE/count(*) FILTER (label=1),4) AS weight FROM corpus WHERE split='train'",
    "corpus",
)
def class_weight(spark, sf):
    return P.class_weight(P.by_split(V.corpus(spark, sf), "train"))


@query(
    "overview",
    f"SELECT coalesce(split,'total') AS split, count(*) AS n, {_POS} AS pos, {_NEG} AS neg, "
    f"{pct('coalesce(sum(label),0)','count(label)',3)} AS pct, count(DISTINCT source) AS sources FROM corpus_all GROUP BY ROLLUP(split)",
    "corpus_all",
)
def overview(spark, sf):
    return P.overview(V.corpus_all(spark, sf))


@query(
    "dominant_share",
    f"""SELECT {pct(f'count(*) FILTER ({IN_DOMINANT})','count(*)')} AS rows_pct, {pct(f'coalesce(sum(label) FILTER ({IN_DOMINANT}),0)','sum(label)',1)} AS pos_pct,
      count(*) FILTER (NOT {IN_DOMINANT}) AS n_outside, coalesce(sum(label) FILTER (NOT {IN_DOMINANT}),0)::BIGINT AS pos_outside,
      count(DISTINCT CASE WHEN NOT {IN_DOMINANT} THEN source END) AS sources_outside FROM corpus_all""",
    "corpus_all",
)
def dominant_share(spark, sf):
    return P.dominant_share(V.corpus_all(spark, sf), DOMINANT)


_PROFILE = f"""sp AS (SELECT source, count(*) AS n, {_POS} AS pos, {pct('coalesce(sum(label),0)','count(label)')} AS pct, {_NEG} AS neg,
  {pct('coalesce(sum(label),0)','greatest(sum(sum(label)) OVER (),1)')} AS pos_share FROM corpus_all GROUP BY source)"""


@query("source_profile", "SELECT * FROM sp", "corpus_all", _PROFILE)
def source_profile(spark, sf):
    return P.source_profile(V.corpus_all(spark, sf))


@query(
    "top_rate_sources",
    r"SELECT regexp_replace(source,'^(.*?)www\.','\1') AS host, n, pos, pct FROM sp WHERE n>=5 ORDER BY pct DESC, source LIMIT 18",
    "corpus_all",
    _PROFILE,
)
def top_rate_sources(spark, sf):
    return P.top_rate_sources(V.corpus_all(spark, sf))


_CROSS = (
    f"sx AS (SELECT source, count(*) AS n_total, {_POS} AS pos_total, {pct('coalesce(sum(label),0)','count(label)')} AS pct, "
    + ", ".join(f"count(*) FILTER (split='{s}') AS n_{s}, count(*) FILTER (split='{s}' AND label=1) AS pos_{s}" for s in S.SPLITS)
    + " FROM {t} GROUP BY source)"
)


@query("source_by_split", "SELECT * FROM sx", "corpus_all", _CROSS.format(t="corpus_all"))
def source_by_split(spark, sf):
    return P.source_by_split(V.corpus_all(spark, sf))


@query("shortcut_sources", "SELECT source, n_total, pos_total, pct FROM sx WHERE n_total>=5 AND pct>=10", "corpus_all", _CROSS.format(t="corpus_all"))
def shortcut_sources(spark, sf):
    return P.shortcut_sources(V.corpus_all(spark, sf))


@query(
    "sources_unseen_in_train",
    "SELECT source, n_dev, pos_dev, n_test, pos_test FROM sx WHERE n_train=0 AND (n_dev>0 OR n_test>0)",
    "web",
    _CROSS.format(t="web"),
)
def sources_unseen_in_train(spark, sf):
    return P.sources_unseen_in_train(V.web(spark, sf))


@query(
    "outside_top_sources",
    f"""SELECT sum(n) FILTER (r>2)::BIGINT AS n_outside, {pct('sum(n) FILTER (r>2)','sum(n)',1)} AS rows_pct, sum(p) FILTER (r>2)::BIGINT AS pos_outside,
      {pct('sum(p) FILTER (r>2)','greatest(sum(p),1)',1)} AS pos_pct FROM (SELECT source, count(*) AS n, sum(label) AS p,
      row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM corpus_all GROUP BY source)""",
    "corpus_all",
)
def outside_top_sources(spark, sf):
    return P.outside_top_sources(V.corpus_all(spark, sf))


@query(
    "shortest_texts",
    """SELECT split, chars, label, source, url, text FROM (SELECT *, length(text)::INT AS chars,
      row_number() OVER (PARTITION BY split ORDER BY length(text), doc_id) AS r FROM corpus_all) WHERE r<=8""",
    "corpus_all",
)
def shortest_texts(spark, sf):
    return P.shortest_texts(V.corpus_all(spark, sf))


def _describe(col: str, qs: dict[str, float], extra: str = "") -> str:
    parts = ", ".join(f"round_even(quantile_cont({col}::DOUBLE,{q}),4) AS {k}" for k, q in qs.items())
    return f"SELECT split, label, count(*) AS n, min({col})::BIGINT AS min, {parts}{extra}, max({col})::BIGINT AS max FROM c GROUP BY split, label"


@query(
    "length_describe",
    _describe("chars", {"q25": 0.25, "p50": 0.5, "q75": 0.75, "p90": 0.9}, ", round_even(avg(chars::DOUBLE),4) AS mean"),
    "corpus_all",
    "c AS (SELECT split, label, length(text) AS chars FROM corpus_all)",
)
def length_describe(spark, sf):
    return P.length_describe(V.corpus_all(spark, sf))


def _tokens(df):
    return df.withColumn("tokens", K.word_token_count(F.col("text"))).drop("text")


def _estimated(df):
    return df.withColumn("tokens", K.estimated_tokens(F.char_length("text"))).drop("text")


_TOK = f"c AS (SELECT split, label, (len({TOKENS})+2)::INT AS tokens FROM corpus_all)"
_ESTC = f"c AS (SELECT split, label, {EST} AS tokens FROM corpus_all)"


@query("token_describe", _describe("tokens", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}), "corpus_all", _TOK)
def token_describe(spark, sf):
    return P.token_describe(_tokens(V.corpus_all(spark, sf)))


@query(
    "truncation_by_class",
    f"""SELECT CASE WHEN grouping(split)=1 THEN 'all' ELSE split END AS split, label, count(*) AS n, round_even(quantile_cont(tokens::DOUBLE,0.5),4) AS med,
      round_even(quantile_cont(tokens::DOUBLE,0.75),4) AS q75, count(*) FILTER (tokens>512) AS truncated, {pct('count(*) FILTER (tokens>512)','count(*)',1)} AS pct
      FROM c GROUP BY GROUPING SETS ((split,label),())""",
    "corpus_all",
    _ESTC,
)
def truncation_by_class(spark, sf):
    return P.truncation_by_class(_estimated(V.corpus_all(spark, sf)))


@query(
    "context_coverage",
    f"""SELECT label, lim AS "limit", count(*) AS n, count(*) FILTER (tokens<=lim) AS covered, {pct('count(*) FILTER (tokens<=lim)','count(*)',2)} AS pct
      FROM c, (VALUES (512),(1024),(2048),(4096)) t(lim) GROUP BY label, lim""",
    "corpus_all",
    _ESTC,
)
def context_coverage(spark, sf):
    return P.context_coverage(_estimated(V.corpus_all(spark, sf)))


def _hist(bins: int, cell: str, extra: str) -> str:
    return f"""SELECT g.label, g.bin, coalesce(b.n,0)::BIGINT AS n, g.total, {pct('coalesce(b.n,0)','g.total')} AS pct, {extra}
      FROM (SELECT label, total, unnest(range({bins}))::INT AS bin FROM (SELECT label, count(*) AS total FROM c GROUP BY label)) g
      LEFT JOIN (SELECT label, {cell} AS bin, count(*) AS n FROM c GROUP BY 1,2) b ON g.label IS NOT DISTINCT FROM b.label AND g.bin=b.bin"""


_X = "log10(greatest(chars,1)::DOUBLE)"
_LOW, _WIDTH = "2.0::DOUBLE", "((4.7::DOUBLE-2.0::DOUBLE)/27)"
@query(
    "length_histogram",
    _hist(27, f"CASE WHEN {_X}=4.7::DOUBLE THEN 26 WHEN {_X}>=2 AND {_X}<4.7::DOUBLE THEN least(floor(({_X}-{_LOW})/{_WIDTH})::INT,26) END",
          f"round_even(pow(10::DOUBLE,{_LOW}+g.bin*{_WIDTH}),0)::BIGINT AS lower"),
    "corpus_all",
    "c AS (SELECT label, length(text) AS chars FROM corpus_all)",
)
def length_histogram(spark, sf):
    return P.length_histogram(V.corpus_all(spark, sf))


@query(
    "token_histogram",
    _hist(24, "(least(tokens,1535)//64)::INT", "CASE WHEN g.bin=23 THEN (g.bin*64)::VARCHAR||'+' ELSE (g.bin*64)::VARCHAR END AS range"),
    "corpus_all",
    _ESTC,
)
def token_histogram(spark, sf):
    return P.token_histogram(_estimated(V.corpus_all(spark, sf)))


@query(
    "term_prevalence",
    f"""SELECT term, count(*) FILTER (m) AS docs, count(*) FILTER (m AND label=1) AS pos, {pct('count(*) FILTER (m AND label=1)','count(*) FILTER (m)',1)} AS pct_pos
      FROM (SELECT label, term, contains(lower(text),term) AS m FROM corpus_all, (SELECT unnest([{','.join(f"'{t}'" for t in TERMS)}]) AS term)) GROUP BY term""",
    "corpus_all",
)
def term_prevalence(spark, sf):
    return P.term_prevalence(V.corpus_all(spark, sf), TERMS)


@query(
    "source_terms",
    f"""SELECT term, docs, source, source_docs, round_even(source_docs::DOUBLE/docs,4) AS share FROM (
      SELECT term, source, count(*) AS source_docs, sum(count(*)) OVER (PARTITION BY term)::BIGINT AS docs,
        row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, source) AS r FROM (
        SELECT DISTINCT doc_id, source, unnest({TOKENS}) AS term FROM corpus_all) GROUP BY term, source)
      WHERE r=1 AND docs>=5 AND source_docs::DOUBLE/docs>=0.5""",
    "corpus_all",
)
def source_terms(spark, sf):
    return P.source_terms(V.corpus_all(spark, sf))


@query(
    "pattern_audit",
    " UNION ALL ".join(
        f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(text,'{p}')) AS docs, count(*) FILTER (regexp_matches(text,'{p}') AND label=1) AS pos, "
        f"count(DISTINCT CASE WHEN regexp_matches(text,'{p}') THEN source END) AS sources FROM corpus_all"
        for k, p in PATTERNS.items()
    ),
    "corpus_all",
)
def pattern_audit(spark, sf):
    return P.pattern_audit(V.corpus_all(spark, sf), PATTERNS)


@query(
    "sample_search",
    f"""SELECT doc_id, split, source, label, url, length(text)::BIGINT AS chars, substr(text,1,320) AS excerpt FROM corpus_all
      WHERE split='train' AND label=0 AND contains(lower(text),'the') ORDER BY {RANK}, doc_id LIMIT 25 OFFSET 25""",
    "corpus_all",
)
def sample_search(spark, sf):
    return P.sample_search(V.corpus_all(spark, sf), page=1, split="train", label=0, q="The ")


@query(
    "search_total",
    "SELECT count(*) AS total FROM corpus_all WHERE source='src3' AND contains(lower(text),'ing')",
    "corpus_all",
)
def search_total(spark, sf):
    return P.search_total(V.corpus_all(spark, sf), split="all", source="src3", q="ING")
