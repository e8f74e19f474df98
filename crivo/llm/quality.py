"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms are compared by Jensen-Shannon divergence (base 2, 0 to 1) with the reference of the document's language:
the shares of seven character classes, and the shares of the language's most common words with one bin for all others.
The references are counted over all other documents of a language, however rare it is: a document's own counts are taken
off, so none is its own norm. Short documents give noisy histograms, so each comparison has a least length, of the document and of the reference, below which it passes no judgement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crivo.session import materialise

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COMMON_WORDS = 16
#: The most common words of a language are found among the most common ones of as many parts of its vocabulary.
WORD_PARTS = 64
#: References of languages with this share of the documents are broadcast: 1000 at most. Others are joined by language.
OFTEN_SHARE = 0.001
MAX_CLASS_DIVERGENCE = 0.10
MAX_WORD_DIVERGENCE = 0.20
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100
#: Other text of its language that a document is judged by, at least: ten times what a document needs, and its own length.
MIN_REFERENCE_CHARS = 10 * MIN_CLASS_CHARS
MIN_REFERENCE_WORDS = 10 * MIN_COMMON_WORDS

#: Character classes in the order they are taken off a text without white space; what is left over is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "\\p{L}+", "\\p{N}+", "[.,;:!?'\"()-]+")
N_CLASSES = len(CLASSES) + 2  # and white space, and the rest


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _words() -> Column:
    bare = F.expr("trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM text)")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def class_counts(df: DataFrame) -> DataFrame:
    """Add `classes`, the character counts of `text` by class, and `n_symbols`, from `bare`, the text without white space.

    Each pass works on what the last one left over, so only the first one sees the whole text.
    """
    df = df.withColumn("rest0", F.col("bare"))
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"rest{i + 1}", F.regexp_replace(f"rest{i}", pattern, ""))
    sizes = [F.length(f"rest{i}") for i in range(len(CLASSES) + 1)]
    counts = [F.length("text") - F.length("bare"), *(a - b for a, b in zip(sizes, sizes[1:])), sizes[-1]]
    df = df.withColumn("classes", F.array(*[c.cast("long") for c in counts]))
    df = df.withColumn("n_symbols", (F.length("rest1") - F.length(F.regexp_replace("rest1", SYMBOLS, ""))).cast("long"))
    return df.drop(*[f"rest{i}" for i in range(len(CLASSES) + 1)])


def repeat_words(df: DataFrame) -> DataFrame:
    """Add `n_repeat_words`: words inside a 3-word window that the text has twice or more, the first one included.

    Windows are compared by 64-bit hashes. Only a text with equal hashes has its windows sorted, by hash and position:
    equal ones are then neighbours, and the words they cover are counted from the gaps between their positions.
    """
    df = df.withColumn(
        "windows",
        F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"),
    )
    df = df.withColumn(
        "ordered",
        F.expr("CASE WHEN size(array_distinct(windows)) = size(windows) THEN cast(array() AS array<struct<h: bigint, i: int>>) ELSE sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    df = df.withColumn(
        "at",
        F.expr("sort_array(transform(filter(ordered, (x, j) -> (j > 0 AND get(ordered, j - 1).h = x.h) OR (j + 1 < size(ordered) AND get(ordered, j + 1).h = x.h)), x -> x.i))"),
    )
    covered = "CASE WHEN size(at) = 0 THEN 0 ELSE aggregate(transform(at, (p, j) -> least(3, coalesce(get(at, j + 1) - p, 3))), 0, (s, g) -> s + g) END"
    return df.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("windows", "ordered", "at")


def references(docs: DataFrame, common_words: int = COMMON_WORDS, share: float = OFTEN_SHARE) -> DataFrame:
    """One row per language that is not null.

    often: it has `share` of the documents; ref_classes: its characters by class; common: its most common words, ties in word
    order; common_n: how often they occur; ref_words: all its words.
    """
    texts = _texts(docs, F.col("lang").cast("string").alias("lang")).withColumn("bare", F.regexp_replace("text", f"{SPACE}+", ""))
    texts = class_counts(texts)
    counts = texts.select("lang", *[F.col("classes")[i].alias(f"c{i}") for i in range(N_CLASSES)])
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(N_CLASSES)]
    classes = materialise(counts.groupBy("lang").agg(F.count("*").alias("n_docs"), *sums), "class-counts")
    words = _texts(docs, F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").select("lang", F.explode(_words()).alias("word"))
    words = materialise(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")

    total = classes.groupBy().agg(F.sum("n_docs").alias("of")).select("of")
    classes = classes.withColumn("often", F.col("n_docs") >= F.lit(share) * total.scalar()).where("lang IS NOT NULL")
    totals = words.groupBy("lang").agg(F.sum("n").alias("ref_words"))
    top = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(WORD_PARTS)))
    for by in (["lang", "part"], ["lang"]):  # a language may have most of the words
        top = top.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common_words)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    out = classes.join(totals, "lang", "left").join(top, "lang", "left")
    return out.select(
        "lang",
        "often",
        F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("ref_classes"),
        F.expr("coalesce(top.word, cast(array() AS array<string>))").alias("common"),
        F.expr("coalesce(top.n, cast(array() AS array<bigint>))").alias("common_n"),
        F.coalesce("ref_words", F.lit(0)).alias("ref_words"),
    )


def with_references(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Add the references of `lang` to every row; a null lang has none.

    Only rows of rare languages, none of which has many rows, are shuffled to meet their references.
    """
    refs = refs.withColumnRenamed("lang", "ref_lang")
    often, rare = F.broadcast(refs.where("often")), refs.where("NOT often")  # 1000 rows at most
    if rare.isEmpty():
        return df.join(often, df["lang"] == often["ref_lang"], "left")
    known = df.join(often, df["lang"] == often["ref_lang"], "left").where("ref_lang IS NOT NULL OR lang IS NULL")
    keys = F.broadcast(refs.where("often").select(F.col("ref_lang").alias("often_lang")))
    others = df.where("lang IS NOT NULL").join(keys, df["lang"] == F.col("often_lang"), "left_anti")
    rare = rare.hint("merge")
    return known.unionByName(others.join(rare, others["lang"] == rare["ref_lang"]))


def divergence(p: str, q: str) -> Column:
    """Jensen-Shannon divergence, base 2, of two share arrays of one length."""
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (x + y)) ELSE 0D END"
    return F.expr(f"0.5D * aggregate(zip_with({p}, {q}, (x, y) -> {half.format('x')} + {half.format('y')}), 0D, (s, v) -> s + v)")


def quality(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_class_divergence: float = MAX_CLASS_DIVERGENCE,
    max_word_divergence: float = MAX_WORD_DIVERGENCE,
    min_class_chars: int = MIN_CLASS_CHARS,
    min_common_words: int = MIN_COMMON_WORDS,
) -> DataFrame:
    """Judge every row of `docs` (text, lang, ...); one row out per row in, repeated ones too.

    row (a struct of all columns of `docs`, so that no name clashes), n_words (runs of characters other than the six ASCII white-space ones), word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed (under `min_words` words, or over `max_repeat_percent` of them repeat), class_divergence,
    word_divergence, kept. A text is kept if it passes the base rules and each histogram that is long enough to judge is
    close to that of its language's other documents. A null text has no words and fails. A divergence is null, and passes, where
    there is no reference: with a null lang, or where the language's other text is short or shorter than the document itself. An
    empty table gives no rows.
    """
    refs = materialise(references(docs), "references")
    df = _texts(docs, F.struct("*").alias("row"), F.col("lang").cast("string").alias("lang"))
    df = with_references(df, refs).withColumn("common", F.expr("coalesce(common, cast(array() AS array<string>))"))
    df = df.withColumn("words", _words())
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("bare", F.array_join("words", ""))
    df = class_counts(df).withColumn("word_chars", F.length("bare").cast("long")).drop("bare")
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = repeat_words(df)
    df = df.withColumn("hits", F.expr("transform(common, c -> n_words - size(array_remove(words, c)))"))
    df = df.withColumn("other", F.expr("n_words - aggregate(hits, 0L, (s, h) -> s + h)"))
    df = df.withColumn("own_words", F.expr("transform(concat(hits, array(other)), h -> h / greatest(n_words, 1))"))
    df = df.withColumn("own_classes", F.expr("transform(classes, c -> c / greatest(length(text), 1))"))
    df = df.withColumn("left_classes", F.expr("zip_with(ref_classes, classes, (t, c) -> t - c)")).withColumn("left_words", F.expr("ref_words - n_words"))
    df = df.withColumn("left_chars", F.expr("aggregate(left_classes, 0L, (s, c) -> s + c)"))
    df = df.withColumn("class_share", F.expr(f"CASE WHEN left_chars >= greatest({MIN_REFERENCE_CHARS}, length(text)) THEN transform(left_classes, c -> c / left_chars) END"))
    df = df.withColumn("shares", F.expr(f"CASE WHEN left_words >= greatest({MIN_REFERENCE_WORDS}, n_words) THEN zip_with(common_n, hits, (t, h) -> (t - h) / left_words) END"))
    df = df.withColumn("word_share", F.expr("concat(shares, array(1 - aggregate(shares, 0D, (s, x) -> s + x)))"))
    df = df.withColumn("class_divergence", divergence("own_classes", "class_share"))
    df = df.withColumn("word_divergence", divergence("own_words", "word_share"))
    df = df.withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"))
    close = F.expr(
        f"(length(text) < {min_class_chars} OR class_divergence IS NULL OR class_divergence <= {max_class_divergence}D) AND "
        f"(n_words < {min_common_words} OR word_divergence IS NULL OR word_divergence <= {max_word_divergence}D)"
    )
    # A filter on the verdict must not be pushed below the steps above: it would repeat them inside each other.
    kept = (~F.col("base_failed")) & close & (F.monotonically_increasing_id() >= 0)
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", kept.alias("kept"))
