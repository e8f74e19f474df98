import re

from pyspark.sql import functions as F

from crivo.functions import scores as SC, text as X, tokens as K, urls as U


def col(spark, values, expr, schema="id int, v string"):
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in df.orderBy("id").select(expr(F.col("v"))).collect()]


def test_space_matches_python(spark):
    values = ["a  b", "a b ", "A b", "a\x1cb", "a\x0bb", "", " a b\u0085", "​a b"]
    assert col(spark, values, X.normalize_space) == [re.sub(r"\s+", " ", v).strip() for v in values]
    h = col(spark, values, X.norm_hash)
    assert h[0] == h[1] == h[3] == h[4] and h[0] != h[2]
    folded = col(spark, values, X.folded_hash)
    assert folded[0] == folded[2]


def test_word_tokens_match_python(spark):
    values = ["Ação é boa_x 12 a b", "", "x", "naïve café ok"]
    want = [re.findall(r"(?u)\b\w\w+\b", v.lower()) for v in values[:3]]
    assert col(spark, values[:3], X.word_tokens) == want


def test_ngrams_of_short_texts(spark):
    out = col(spark, ["", "aa", "aa bb", "aa bb cc dd"], lambda c: X.ngrams(X.word_tokens(c), 1, 3))
    assert out[:3] == [[], ["aa"], ["aa", "bb", "aa bb"]]
    assert out[3] == ["aa", "bb", "cc", "dd", "aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"]


def test_footer(spark):
    values = [
        "fim. Redação ICL EconomiaCom informações da Folha",
        "fim. Redação ICL Com informações do G1 Relacionados outra notícia",
        "fim. Redação ICL açãoCom informações da BBC\nmais",
        "sem rodapé",
        None,
    ]
    once = col(spark, values, X.strip_footer)
    assert once == ["fim.", "fim. Relacionados outra notícia", "fim.", "sem rodapé", None]
    assert col(spark, once, X.strip_footer) == once


def test_compose_mask_heavy(spark):
    assert col(spark, ["see https://a.b/c now www.x.y bit.ly/z t.co/1 sport.co/x"], lambda c: X.compose_text(F.lit("T"), c)) == [
        "T see now sport.co/x"
    ]
    assert col(spark, ["G1 diz que g10 e g1"], lambda c: X.mask_terms(c, ["g1"])) == ["  diz que g10 e  "]
    assert col(spark, ["A AÇÃO da não ação"], lambda c: X.heavy_normalize(c, ["não", "da"])) == ["acao acao"]


def test_canonical_url(spark):
    urls = ["https://WWW.a.com/X/", "http://a.com/x?utm=1", "a.com/x", "https://a.com:80/x", "http://a.com/x y#f", " http://a.com/x "]
    assert col(spark, urls, U.canonical_url) == ["a.com/x", "a.com/x", "a.com/x", "a.com:80/x", "a.com/x y", "a.com/x"]
    slugs = ["http://a.com/n-2/", "http://a.com/n-123", "http://a.com/n"]
    assert col(spark, slugs, lambda c: U.canonical_url(c, True)) == ["a.com/n", "a.com/n-123", "a.com/n"]
    assert col(spark, slugs, U.canonical_url)[0] == "a.com/n-2"


def test_suspicious_pages(spark):
    urls = ["https://assinaturas.a.b/x", "https://conta.a.b/x", "https://bsky.app/u", "https://a.b/?p=1", "https://a.b", "https://www.a.b/x"]
    assert col(spark, urls, U.is_suspicious_page) == [True] * 5 + [False]
    assert col(spark, ["www.a.www.b"], U.display_host) == ["a.www.b"]


def test_head_tail(spark):
    df = spark.createDataFrame([(list(range(20)),), (list(range(7)),)], "v array<int>")
    enc = df.select(K.encode_fixed(F.col("v"), 9, 3, 101, 102, 0).alias("e")).select("e.*").collect()
    assert enc[0].input_ids == [101, 0, 1, 2, 16, 17, 18, 19, 102] and enc[0].attention_mask == [1] * 9
    assert enc[1].input_ids == [101, 0, 1, 2, 3, 4, 5, 6, 102]
    short = spark.createDataFrame([([5],)], "v array<int>").select(K.encode_fixed(F.col("v"), 5, 1, 101, 102, 0).alias("e")).first().e
    assert short.input_ids == [101, 5, 102, 0, 0] and short.attention_mask == [1, 1, 1, 0, 0]


def test_token_counters(spark):
    count = K.tokenizer_count(lambda texts: [t.split() for t in texts], batch=2)
    assert col(spark, ["a b c", "", "x y"], count) == [3, 0, 2]
    assert col(spark, ["abcdefg"], lambda c: K.estimated_tokens(F.char_length(c))) == [3]


def test_scores(spark):
    df = spark.createDataFrame([(1000.0, 0.0, 0.0), (-1000.0, 1.0, 2.0)], "s double, a double, b double")
    r = df.select(SC.sigmoid(F.col("s")), SC.softmax_positive(F.col("a"), F.col("b")), SC.argmax2(F.col("a"), F.col("b"))).collect()
    assert abs(r[0][0] - 1) < 1e-12 and r[0][1] == 0.5 and r[0][2] == 0 and r[1][2] == 1
