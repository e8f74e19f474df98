"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crivo.llm import attention_lm, embedclass, exactdedup, langid, mixing, neardup, packing, prefixtrie, quality, rollups, toxicity, variants, warc
from crivo.plans.registry import query
from crivo.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_part(key: str, parts: int) -> Column:
    """crc32 of an identifier as text, modulo `parts`; a null one is empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


@query("op1_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_near_duplicates",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END) AS shingle
    FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT y, seen FROM r JOIN both_ways ON x = doc_id)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {10 * part + 1}, 10))::BIGINT >> {shift}) & 31) + 1)::INT, 1)"
    for part in range(4)
    for shift in range(35, -1, -5)
)


@query(
    "op3_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
""",
)
def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), uri)
    return warc.read_archives(spark, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_WORDS = "size(regexp_extract_all(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0))"
_PIECES = "size(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\\\\x20\\\\x09-\\\\x0DA-Za-z0-9]', 0))"


@query(
    "op4_token_counts",
    """
WITH counted AS (
    SELECT source, lang,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words,
           len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\\x20\\x09-\\x0DA-Za-z0-9]'))::BIGINT AS pieces
    FROM documents
), present AS (
    SELECT source, lang, 'words-1' AS version, words + 1 AS tokens, words >= 50 AS there FROM counted
    UNION ALL
    SELECT source, lang, 'pieces-1', pieces, TRUE FROM counted
)
SELECT source, lang, version, CAST(sum(there::INT) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN there THEN tokens ELSE 0 END) AS BIGINT) AS n_tokens
FROM present GROUP BY ALL
""",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents under two tokenizers, revise one count by an end token, delete short documents; repeat batches."""
    docs = table(spark, sf_dir, "documents")
    words, pieces = F.expr(_WORDS), F.expr(_PIECES)
    rollup = rollups.Rollup(spark, scratch(spark, "rollup"))
    batches = {
        "1-words": rollups.changes(docs, "insert", "words-1", words),
        "2-pieces": rollups.changes(docs, "insert", "pieces-1", pieces),
        "3-ends": rollups.changes(docs, "revise", "words-1", words + 1, words),
        "4-short": rollups.changes(docs.where(words < 50), "delete", "words-1", was=words + 1),
    }
    for name in ("1-words", "2-pieces", "3-ends", "3-ends", "4-short", "1-words"):
        rollup.commit(name, batches[name])
        if name == "2-pieces":
            rollup.compact()
    return rollup.totals()


@query("op5_attention_lm")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.language_scores(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op6_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.learn(docs, labels.where(crc_part("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (crc_part("doc_id", 5) == 0).alias("held_out"))
    scored = toxicity.score(rows, field)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_BASE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
g AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t)
SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _js_sql(p: str, q: str) -> str:
    half = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(2 * z[{0}] / (z[1] + z[2])) ELSE 0 END"
    return f"0.5 * list_sum(list_transform(list_zip({p}, {q}), lambda z: {half.format(1)} + {half.format(2)}))"


_KEEP_SQL = f"""
WITH base AS ({_BASE_SQL}),
t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
k0 AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS r0, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
k1 AS (SELECT *, regexp_replace(r0, '[a-z]+', '', 'g') AS r1 FROM k0),
k2 AS (SELECT *, regexp_replace(r1, '[A-Z]+', '', 'g') AS r2 FROM k1),
k3 AS (SELECT *, regexp_replace(r2, '\\p{{L}}+', '', 'g') AS r3 FROM k2),
k4 AS (SELECT *, regexp_replace(r3, '\\p{{N}}+', '', 'g') AS r4 FROM k3),
k5 AS (SELECT *, regexp_replace(r4, '[.,;:!?''"()-]+', '', 'g') AS r5 FROM k4),
k AS (
    SELECT doc_id, lang, text, words, [length(text) - length(r0), length(r0) - length(r1), length(r1) - length(r2),
        length(r2) - length(r3), length(r3) - length(r4), length(r4) - length(r5), length(r5)] AS cls FROM k5
),
cs AS (
    SELECT lang, list(n ORDER BY i) AS ns FROM (SELECT lang, i, sum(c) AS n FROM (
        SELECT lang, unnest(cls) AS c, unnest(range(7)) AS i FROM k WHERE lang IS NOT NULL) GROUP BY ALL) GROUP BY lang
),
wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM k WHERE lang IS NOT NULL) GROUP BY ALL),
wt AS (SELECT lang, sum(n)::BIGINT AS total FROM wc GROUP BY lang),
tops AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth FROM wc),
wr AS (SELECT lang, list(word ORDER BY nth) AS common, list(n ORDER BY nth) AS common_n FROM tops WHERE nth <= 16 GROUP BY lang),
h AS (
    SELECT doc_id, text, words, cls, common_n, total - len(words) AS left_words, list_transform(list_zip(ns, cls), lambda z: z[1] - z[2]) AS left_cls,
        list_transform(common, lambda c: len(list_filter(words, lambda w: w = c))) AS hits
    FROM k LEFT JOIN cs USING (lang) LEFT JOIN wr USING (lang) LEFT JOIN wt USING (lang)
),
r AS (
    SELECT *, list_transform(left_cls, lambda x: x::DOUBLE / greatest(list_sum(left_cls), 1)) AS ref_cls,
        list_transform(list_zip(common_n, hits), lambda z: (z[1] - z[2])::DOUBLE / greatest(left_words, 1)) AS share FROM h
),
d AS (
    SELECT doc_id, length(text) AS chars,
        CASE WHEN list_sum(left_cls) >= greatest(2000, length(text)) THEN {_js_sql('list_transform(cls, lambda x: x::DOUBLE / greatest(length(text), 1))', 'ref_cls')} END AS class_divergence,
        CASE WHEN left_words >= greatest(1000, len(words)) THEN {_js_sql('list_transform(list_append(hits, len(words) - list_sum(hits)), lambda x: x::DOUBLE / greatest(len(words), 1))', 'list_append(share, 1 - list_sum(share))')} END AS word_divergence
    FROM r
)
SELECT base.*, round_even(class_divergence, 6) AS class_divergence, round_even(word_divergence, 6) AS word_divergence,
    NOT base_failed AND (chars < 200 OR class_divergence IS NULL OR class_divergence <= 0.10) AND (n_words < 100 OR word_divergence IS NULL OR word_divergence <= 0.20) AS kept
FROM base JOIN d USING (doc_id)
"""


@query("op7_quality", _KEEP_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    rounded = [F.bround(c, 6).alias(c) if c.endswith("_divergence") else F.col(c) for c in judged.columns[1:]]
    return judged.select("row.doc_id", *rounded)


@query(
    "op8_exact_dedup",
    """
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
    FROM documents
), k AS (
    SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
""",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(table(spark, sf_dir, "documents")).drop("locator")


_EDF = """(
    SELECT 0::BIGINT AS slot, list_transform({ns}, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM l
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda x, i: x + (i = best)::BIGINT), best FROM (
        SELECT slot, done, list_min(list_filter(list_transform(done, lambda x, i:
            CASE WHEN x < {ns}[i] AND (x * {m}) // {ns}[i] <= slot THEN (((x + 1) * {m} + {ns}[i] - 1) // {ns}[i]) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS best
        FROM {name}, l WHERE slot < {m})
)"""
_SLOTS = "SELECT names[pick] AS source, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block, {ns}[pick] AS n, {m} AS m FROM {name}, l WHERE pick > 0"


@query(
    "op9_mixing",
    f"""
WITH RECURSIVE q AS (
    SELECT source, count(*) AS n, least(count(*), ceil(0.25 * (SELECT count(*) FROM documents))::BIGINT) AS quota FROM documents GROUP BY source
),
z AS (SELECT greatest(1, (sum(quota)::BIGINT + 2047) // 2048) AS size, greatest(1, (sum(n - quota)::BIGINT + 2047) // 2048) AS late_size FROM q),
b AS (SELECT source, (quota + size - 1) // size AS early, (n - quota + late_size - 1) // late_size AS late FROM q, z),
l AS (SELECT list(source ORDER BY source) AS names, list(early ORDER BY source) AS es, list(late ORDER BY source) AS ls, sum(early)::BIGINT AS me, sum(late)::BIGINT AS ml FROM b),
early AS {_EDF.format(ns='es', m='me', name='early')},
late AS {_EDF.format(ns='ls', m='ml', name='late')},
plan AS (
    SELECT FALSE AS after, *, 0::BIGINT AS first FROM ({_SLOTS.format(ns='es', m='me', name='early')})
    UNION ALL SELECT TRUE, s.*, me FROM ({_SLOTS.format(ns='ls', m='ml', name='late')}) s, l
),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) - 1 AS nth FROM documents),
p AS (
    SELECT doc_id, d.source, nth >= quota AS after, CASE WHEN nth >= quota THEN (nth - quota) // late_size ELSE nth // size END AS at,
           CASE WHEN nth >= quota THEN (nth - quota) % late_size ELSE nth % size END AS place
    FROM d JOIN q USING (source) CROSS JOIN z
)
SELECT doc_id, p.source, block + CASE WHEN p.after THEN early ELSE 0 END AS block, first + (block * m) // n AS release,
       first + ((block + 1) * m + n - 1) // n AS deadline, first + slot AS slot, place
FROM p JOIN b USING (source) JOIN plan ON plan.source = p.source AND plan.after = p.after AND plan.block = p.at
""",
)
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), excess=True)
    names = ("block", "release", "deadline", "slot", "place")
    return out.select("doc_id", "source", *[F.col(f"_{n}").alias(n) for n in names])


@query("op10_language")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_part("doc_id", 4) == 2)
    model = langid.learn(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


#: The table of CRC-32 by its rule, and the checksum of a string's UTF-8 bytes.
_CRC_TABLE = """crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc_table
)"""


def _crc_sql(text: str) -> str:
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)),"
        " lambda c, b: xor(c >> 8, crc_table[xor(c, b) % 256 + 1])), 4294967295::BIGINT)"
    )


@query(
    "op11_prefix_trie",
    f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns
    FROM t GROUP BY conv_id
),
h AS (SELECT conv_id, turns, {_crc_sql("conv_id::VARCHAR")} % 4 AS h FROM c, crc),
r AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS path
    FROM h a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 20
),
p AS (SELECT conv_id, depth, path[1:depth] AS node FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM r)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL),
o AS (SELECT p.conv_id AS member, depth, n.conv_id AS owner FROM p JOIN n USING (node, depth)),
k AS (
    SELECT n.conv_id, n.depth, n.n_convs, o.owner AS parent,
           (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(node[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM n LEFT JOIN o ON o.member = n.conv_id AND o.depth = n.depth - 1
),
g AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
w AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN g ON g.parent = k.conv_id AND g.depth = k.depth),
s AS (
    SELECT owner, o.depth, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
    FROM w JOIN o ON member = w.conv_id AND o.depth <= w.depth GROUP BY ALL
),
e AS (
    SELECT owner, depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids
    FROM o JOIN r ON member = conv_id WHERE depth = len(path) GROUP BY ALL
)
SELECT w.conv_id, w.depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s ON s.owner = w.conv_id AND s.depth = w.depth LEFT JOIN e ON e.owner = w.conv_id AND e.depth = w.depth
""",
)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.numbered(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(*prefixtrie.regrafted(turns))


@query("op12_quality_classifier")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = embedclass.learn(docs, labels.where(crc_part("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (crc_part("doc_id", 5) == 0).alias("held_out"))
    scored = embedclass.score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op13_spelling_variants",
    f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents
),
d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS id, run, count(*) AS times FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, times, {_crc_sql("id")} AS h FROM d, crc),
f AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM f WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
s AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
    SELECT a.word, b.word AS other, b.n FROM s a JOIN s b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM s JOIN w ON rest = w.word
    UNION SELECT w.word, s.word, s.n FROM s JOIN w ON rest = w.word
),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM e GROUP BY word),
v AS (
    SELECT word, CASE WHEN most >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n
    FROM w LEFT JOIN b USING (word)
),
t AS (SELECT word, word AS root FROM v UNION ALL SELECT t.word, v.form FROM t JOIN v ON v.word = t.root WHERE v.form IS NOT NULL),
l AS (SELECT t.word, t.root FROM t JOIN v ON v.word = t.root WHERE v.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM v JOIN l USING (word)
""",
)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents")))
