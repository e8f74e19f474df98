"""Held-out accuracy of the embedding classifier, and its shortcuts against plain sums."""

import random
import zlib

import numpy as np

from crivo.llm import embedclass

from . import edge


def corpus(n=400, seed=2):
    """Prose, and as bad ones: shouting, marks on words, lists, one word over and over, next to some prose."""
    r, rows = random.Random(seed), []
    syllables = "the ing and tion er ly be ou ver ge a".split()

    def prose(k):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(k))

    for i in range(n):
        text, bad = prose(r.randint(20, 200)), i % 4 == 0
        if bad:
            k = i // 4 % 4
            junk = prose(r.randint(60, 200))
            text = prose(10) + "\n" + [junk.upper(), junk.replace(" ", "*** "), junk.replace(" ", " | "), (prose(1) + " ") * 80][k]
        rows.append((i, text, int(not bad)))
    return rows


def test_held_out_accuracy_and_bounded_sample(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.where("doc_id < 300").select("doc_id", "quality")
    model = embedclass.learn(df.drop("quality"), labels, rows=60)
    got = embedclass.score(df.where("doc_id >= 300").drop("quality"), model).collect()
    truth = {i: y for i, _, y in rows}
    assert sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert np.count_nonzero(model.vectors.any(axis=1)) < len(model.vectors) // 2  # nothing learned, nothing added


def test_scorer_is_the_mean_of_vectors():
    rows = corpus(80)
    model = embedclass.fit([t for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    texts = ["", "word", "word word", "a\nb  b\r\n", "x" * 5000, "ß İ 中文 😀 \x00", *[t for _, t, _ in rows[:10]]]
    got = embedclass.Scorer(model).probabilities(texts)
    one = embedclass.Scorer(model)
    for text, p in zip(texts, got):
        at, weight = embedclass.document_features(text)
        assert abs(weight.sum() - 1) < 1e-4
        mean = (model.vectors[at] * weight[:, None]).sum(axis=0)
        want = embedclass.softmax((mean @ model.layer[:-1] + model.layer[-1])[None])[0]
        assert np.allclose(p, want, atol=1e-4) and np.allclose(one.probabilities([text])[0], p)


def test_gradient_of_one_step():
    """One step of one text moves the loss as the step's size says."""
    texts, y = ["good words here", "BAD *** WORDS"], [1, 0]

    def loss(m):
        p = embedclass.Scorer(m).probabilities(texts)
        return -np.log(p[[0, 1], y]).sum()

    losses = [loss(embedclass.fit(texts, y, epochs=e, rate=0.5, batch=2)) for e in (1, 5, 25)]
    assert losses[0] > losses[1] > losses[2]


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(embedclass, "PIECE", 50)
    text = "one two\n" * 40 + "x" * 3000 + " end"
    parts = list(embedclass.words(text))
    assert len(parts) > 3
    flat = [t for p in parts for t in p]
    assert "".join(t for t in flat if t not in (embedclass.LINE, embedclass.END)) == "".join(text.split())
    assert flat.count(embedclass.LINE) == 40 and flat[-1] == embedclass.END


def test_edges(spark):
    rows = corpus(80)
    model = embedclass.fit([t for _, t, _ in rows], [y for *_, y in rows], epochs=1)
    docs = edge.docs(spark)
    got = embedclass.score(docs, model).collect()
    assert len(got) == len(edge.ROWS) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""]
    assert sorted(embedclass.score(docs, model).columns) == sorted(docs.columns)
    assert embedclass.score(edge.empty(spark), model).count() == 0
    none = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")
    assert embedclass.learn(docs, none) is None and embedclass.learn(edge.empty(spark), none) is None
    assert {r["score"] for r in embedclass.score(docs, None).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (5, 0), (8, None)], "doc_id long, quality int")
    assert embedclass.learn(docs, some).classes == [0, 1]


def test_labels_of_held_out_rows_are_not_read(spark):
    from crivo.llm.queries import crc_part

    ids = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", crc_part("doc_id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in ids)
