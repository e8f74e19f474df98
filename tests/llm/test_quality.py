import math
import re
from collections import Counter

from crivo.llm import quality

from . import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = ["a b a b a b a", "x y z\nx y z\n \nx y z", "# $ a|b <c>", "one", "p q r s p q r t p q r", "\x0b a\x0cb \x85 c d", "w " * 500]


def test_base_counts(spark):
    rows = list(edge.ROWS) + [edge.row(50 + i, t) for i, t in enumerate(TEXTS)]
    got = quality.quality(edge.docs(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(base(r[1]) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality(edge.empty(spark)).count() == 0


def classes(text):
    left = re.sub(r"[\x20\x09-\x0D]+", "", text)
    out = [len(text) - len(left)]
    for p in ("[a-z]+", "[A-Z]+", r"[^\W\d_]+", r"\d+", r"[.,;:!?'\"()-]+"):
        rest = re.sub(p, "", left)
        out.append(len(left) - len(rest))
        left = rest
    return out + [len(left)]


def js(p, q):
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return 0.5 * (part(p, q) + part(q, p))


def test_divergences_against_brute_force(spark):
    rows = [edge.row(i, " ".join(f"w{(i * j) % 17}" if j % 3 else "the" for j in range(60 + i)) + ". Ä1", "en") for i in range(30)]
    rows += [edge.row(100 + i, "| " + " | ".join(f"Z{i}{j}#" for j in range(120)), "en") for i in range(2)]
    got = {r["row"]["doc_id"]: r for r in quality.quality(edge.docs(spark, rows)).collect()}
    total = [sum(x) for x in zip(*(classes(r[1]) for r in rows))]
    words = Counter(w for r in rows for w in WORD.findall(r[1]))
    top = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]]
    n = sum(words.values())
    for r in rows:  # against all other documents
        own, mine = classes(r[1]), Counter(WORD.findall(r[1]))
        size = sum(mine.values())
        p, ref = [mine[w] / size for w in top], [(words[w] - mine[w]) / (n - size) for w in top]
        rest = [a - b for a, b in zip(total, own)]
        assert math.isclose(got[r[0]]["class_divergence"], js([x / sum(own) for x in own], [x / sum(rest) for x in rest]), abs_tol=1e-9)
        assert math.isclose(got[r[0]]["word_divergence"], js(p + [1 - sum(p)], ref + [1 - sum(ref)]), abs_tol=1e-9)
    for r in got.values():
        close = len(r["row"]["text"]) < quality.MIN_CLASS_CHARS or r["class_divergence"] <= quality.MAX_CLASS_DIVERGENCE
        close &= r["n_words"] < quality.MIN_COMMON_WORDS or r["word_divergence"] <= quality.MAX_WORD_DIVERGENCE
        assert r["kept"] == (close and not r["base_failed"])
    assert got[100]["class_divergence"] > quality.MAX_CLASS_DIVERGENCE > got[5]["class_divergence"]


def test_rare_and_null_languages_are_not_held_against_others(spark):
    latin = [edge.row(i, " ".join(f"w{(i * j) % 17}" if j % 3 else "the" for j in range(70)), "en") for i in range(2100)]
    kana = [" ".join(chr(0x3042 + j % 40) * (3 + j % 4) + chr(0x3042 + j // 40) for j in range(n)) for n in (120, 500)]
    rows = latin + [edge.row(5000, kana[0], None), edge.row(5001, kana[0], "xx"), edge.row(5002, kana[0], "ja"), edge.row(5003, kana[1], "ja")]
    odd = "| " + " | ".join(f"Z{j}#" for j in range(300))
    rows += [edge.row(5010, " ".join(chr(0x0430 + j % 30) * (3 + j % 4) + str(j) for j in range(4000)), "ru"), edge.row(5011, odd, "ru"), edge.row(5012, odd, "en")]
    got = {r["row"]["doc_id"]: r for r in quality.quality(edge.docs(spark, rows)).collect()}
    assert len(got) == len(rows) and all(len(r[1]) >= quality.MIN_CLASS_CHARS for r in rows)
    assert all(got[i]["class_divergence"] is None and got[i]["word_divergence"] is None for i in (5000, 5001))
    mine, other = classes(rows[-5][1]), classes(rows[-4][1])  # ja, 2 of 2107 documents: the other one is the reference
    assert math.isclose(got[5002]["class_divergence"], js([x / sum(mine) for x in mine], [x / sum(other) for x in other]), abs_tol=1e-9)
    assert got[5003]["class_divergence"] is None  # too little other text
    for i in (5000, 5001, 5002, 5003, 5010):
        assert got[i]["class_divergence"] is None or got[i]["class_divergence"] <= quality.MAX_CLASS_DIVERGENCE
        assert got[i]["kept"] and not got[i]["base_failed"]
    assert not got[5011]["kept"] and not got[5012]["kept"]  # junk in a rare language is still found


def same_as_sql(spark, name, path, rows, schema):
    """Does the registered query give what its SQL says of the table `rows`?"""
    import duckdb

    import crivo.llm.queries  # noqa: F401

    from crivo.plans.registry import ORACLE, QUERIES

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(path)).toPandas(), con.execute(ORACLE[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(rows)
    key = lambda df: sorted((tuple(None if v != v else v for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert key(got) == key(want)


def test_sql_agrees_on_a_rare_language(spark, tmp_path):
    rows = [edge.row(i, " ".join(f"w{(i * j) % 17}" if j % 3 else "the" for j in range(70)), "en") for i in range(60)]
    rows += [edge.row(100 + i, " ".join(chr(0x3042 + j % (30 + i)) * 4 for j in range(400)), "ja") for i in range(4)]
    rows += [edge.row(200, "| " + " | ".join(f"Z{j}#" for j in range(300)), "ja"), edge.row(201, "lone " * 300, "xx"), edge.row(202, "no lang " * 90, None)]
    same_as_sql(spark, "op7_quality", tmp_path, rows, edge.SCHEMA)
