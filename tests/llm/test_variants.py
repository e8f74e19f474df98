"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crivo.llm import variants

from . import edge


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, times=10):
    form, out = {}, []
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = (best if best is not None and counts[best] >= times * n else None, len(others))
    for w, n in counts.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n, form[w][1], counts[f] if f else None))
    return sorted(out, key=repr)


def vocabulary(seed, size, letters="abé", longest=11):
    """Words of few letters, many of them one edit from another, and counts that rise tenfold."""
    r, out = random.Random(seed), {}
    while len(out) < size:
        w = "".join(r.choice(letters) for _ in range(r.randint(1, longest)))
        for _ in range(r.randint(1, 4)):
            out[w] = 10 ** r.randint(0, 5) * r.randint(1, 2)
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]]) or "a"
    return out


@pytest.mark.parametrize("cells", [1 << 16, 200, 1])
def test_against_all_pairs(spark, cells):
    """A small bound cuts the blocks down to words that differ in one place; nothing is lost or counted twice."""
    counts = vocabulary(cells, 260)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, variants.variants(words, cells=cells).collect()), key=repr) == brute(counts)


def test_tiles_and_wide_letters(monkeypatch):
    monkeypatch.setattr(variants, "TILE", 3)
    words = sorted({f"stem{c}end" for c in "abcdefgh中😀"} | {"stemend"})
    found, first = variants.near_in_block(words, 8, 0, 0, 9)  # pairs whose longer word has 8 letters
    for i, w in enumerate(words):
        hits = [j for j, o in enumerate(words) if near(w, o) and max(len(w), len(o)) == 8]
        assert found[i] == len(hits) and first[i] == min(hits, default=len(words))


def test_work_is_bounded(spark):
    """All words agree in their first half: cut blocks compare far fewer pairs than the block has."""
    r = random.Random(1)
    counts = {"commonhalf" + "".join(r.choice("abcdefghij") for _ in range(10)): 1 for _ in range(1500)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    sizes = [s for s, in variants.blocks(words, cells=2000).groupBy("block").count().select("count").collect()]
    assert sum(s * s for s in sizes) < 0.3 * 1500**2


def words_of(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def test_words_of_texts(spark):
    r = random.Random(5)
    rows = [(i if i % 9 else None, " ".join(r.choice(["Éclairage", "éclairage", "ECLAIRAGE", "sevenle", "sixsix", "a1b2c3d4", "naïveté×÷long", "İstanbulun"]) for _ in range(12))) for i in range(60)]
    rows += [(3, "x" * 100_000), (4, "x" * 100_000), (5, None), (6, ""), (7, "éclairage é́clairage")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, variants.word_counts(df).collect()))
    assert got == words_of(rows)
    assert sorted(map(tuple, variants.variants(variants.word_counts(df)).collect()), key=repr) == brute(words_of(rows))


def test_edges(spark):
    docs = edge.docs(spark)
    counts = words_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert dict(map(tuple, variants.word_counts(docs).collect())) == counts
    assert variants.variants(variants.word_counts(edge.empty(spark))).collect() == []
    words = spark.createDataFrame([("", 5), ("a", 50), (None, 7), ("ab", 500), ("y" * 30_000, 2), ("y" * 29_999, 3)], "word string, n long")
    want = brute({"": 5, "a": 50, "ab": 500})
    got = sorted((tuple(r) for r in variants.variants(words).collect() if len(r["word"]) < 9), key=repr)
    assert got == want and np.isfinite(len(got))
    long = {len(r["word"]): r["n_near"] for r in variants.variants(words).collect() if len(r["word"]) > 9}
    assert long == {30_000: 1, 29_999: 1}
