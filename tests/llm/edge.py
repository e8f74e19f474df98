"""Rows that every operator must survive: nulls, empty and long texts, ties, repeats, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, node long, length long, word string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), None, -1.0, 7, 3, "x")


LONG = " ".join(f"w{i % 977} and{i}" for i in range(30_000))
ROWS = [
    row(1, "one two three four five six seven"),
    row(2, "one two three four five six seven"),
    row(2, "one two three four five six seven"),
    row(3, None, None, None),
    row(4, "", None),
    row(5, " \t\n", "de", None),
    row(None, "a row without a name", "de", "b"),
    row(None, "a row without a name", "de", "b"),
    row(6, LONG, "en", "b"),
    row(7, "Über ß İ Σς 中文 😀 <|endoftext|>", "xx", "c"),
    row(8, "12 34 !!", "de", "c"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
