"""Held-out accuracy and numerical checks of the trained models."""

import random

import numpy as np
import pytest

from crivo.llm import attention_lm as lm, langid, toxicity
from crivo.llm.queries import tokenizer_file

from . import edge

SYLLABLES = {"en": "the ing and tion er ly".split(), "de": "ein ung sch der keit ä".split(), "fr": "é le tion eau que ou".split()}


def words(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n=240, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        text = words(r, lang, r.randint(3, 80))
        toxic = i % 4 == 0
        if toxic:
            text += " " + r.choice(["Vileword", "vileness,", "nasty!"]) + " " + words(r, lang, 5)
        rows.append((i, text, lang, int(toxic)))
    return rows


def test_language_held_out(spark):
    rows = [(i, t, g) for i, t, g, _ in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id < 160"))
    got = langid.predict(df.where("doc_id >= 160"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    model = langid.learn(edge.docs(spark))
    got = langid.predict(edge.docs(spark), model)
    assert sorted(got.columns) == sorted([*edge.docs(spark).columns, "lang_pred"])
    for r in got.collect():
        bare = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == bare and (r["score"] == 0 or not bare)
    assert langid.learn(edge.empty(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(edge.docs(spark), None).collect()} == {"und"}
    assert langid.predict(edge.empty(spark), model).count() == 0


def test_kernel_is_presence_of_all_ngrams():
    text = "abcabcäx" * 3
    one, long = np.zeros(langid.CELLS, np.float32), np.zeros(langid.CELLS, np.float32)
    langid.profile(text, one)
    b = text.encode()
    assert one.sum() <= len({b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)})
    big = "a" * ((1 << 20) - 1) + "bcd" + "a" * 10  # an n-gram across two pieces
    langid.profile(big, long)
    short = np.zeros(langid.CELLS, np.float32)
    langid.profile("aaabcdaaa", short)
    assert (long == short).all()


def test_forward_backward_against_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    emission, start, moves = r.normal(size=9), r.normal(size=2), r.normal(size=(2, 2))
    first = np.zeros(9, bool)
    first[[0, 4]] = True
    states, pairs = toxicity.forward_backward(emission, first, start, moves)
    want, moved, total = np.zeros((9, 2)), np.zeros((9, 2, 2)), 0.0
    for y in product((0, 1), repeat=9):
        s = sum(emission[t] * y[t] + (start[y[t]] if first[t] else moves[y[t - 1], y[t]]) for t in range(9))
        p = np.exp(s)
        total += p
        for t in range(9):
            want[t, y[t]] += p
            if not first[t]:
                moved[t, y[t - 1], y[t]] += p
    assert np.allclose(states, want / total) and np.allclose(pairs, moved / total)


def test_long_chain_is_stable():
    n = 5000
    states, _ = toxicity.forward_backward(np.full(n, -3.0), np.arange(n) == 0, np.zeros(2), np.array([[0.0, -3], [-1, 0]]))
    assert np.isfinite(states).all() and np.allclose(states.sum(1), 1)


def test_toxic_held_out(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i < 400] + [(3, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs.where("doc_id >= 400"), toxicity.learn(docs, labels)).collect()
    truth = {i: y for i, _, _, y in rows}
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    for r in got:
        if truth[r["doc_id"]] and r["spans"]:
            assert all(any(w in r["text"][s["start"] : s["end"]].lower() for w in ("vile", "nasty")) for s in r["spans"])


def test_toxic_edges(spark):
    empty = toxicity.learn(edge.docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(edge.docs(spark), empty)
    assert got.count() == len(edge.ROWS) and all(0 <= r["score"] < 0.5 for r in got.collect())
    assert toxicity.score(edge.empty(spark), empty).count() == 0


def test_gradient_of_the_network():
    r = np.random.default_rng(2)
    counts = r.integers(0, 50, lm.VOCABULARY).astype(float)
    theta = lm.start(counts, lm.fold(counts)).astype(np.float64)
    x, y = r.integers(0, lm.CLASSES, (2, 3, lm.WINDOW))
    used = r.random((3, lm.WINDOW)) < 0.8
    _, g = lm.gradient(theta, x, y, used)
    for i in r.choice(len(theta), 25, replace=False):
        step = np.zeros_like(theta)
        step[i] = 1e-4
        d = (lm.gradient(theta + step, x, y, used)[0] - lm.gradient(theta - step, x, y, used)[0]) / 2e-4
        assert abs(d - g[i]) < 1e-3 * max(1, abs(g[i]))


def brute_score(theta, classes, ids):
    """One token at a time, each with the context its window gives it."""
    w = lm.parts(theta.astype(np.float64))
    z = [lm.MARK, *ids, lm.MARK]
    total = 0.0
    for t in range(1, len(z)):
        k = 0 if t <= lm.WINDOW else -(-(t - lm.WINDOW) // lm.STRIDE)
        c = classes.of[np.array(z[k * lm.STRIDE : t])]
        e = w["embed"][c] + w["place"][: len(c)]
        s = (e[-1] @ w["q"]) @ (e @ w["k"]).T / np.sqrt(lm.WIDTH)
        a = np.exp(s - s.max())
        h = e[-1] + (a / a.sum()) @ (e @ w["v"]) @ w["o"]
        o = h @ w["out"] + w["bias"]
        o -= o.max()
        total += (o[classes.of[z[t]]] - np.log(np.exp(o).sum())) / np.log(10) + classes.share[z[t]]
    return total


def test_windows_score_each_token_once():
    r = np.random.default_rng(3)
    counts = r.integers(0, 50, lm.VOCABULARY).astype(float)
    classes = lm.fold(counts)
    assert np.allclose(np.bincount(classes.of, 10.0 ** classes.share.astype(float), lm.CLASSES), 1)
    theta = lm.start(counts, classes)
    texts = [r.integers(0, lm.VOCABULARY, n) for n in (0, 1, 15, 30, 31, 32, 33, 47, 48, 49, 200)]
    got = lm.Scorer(theta, classes).score(texts)
    assert np.allclose(got, [brute_score(theta, classes, t.tolist()) for t in texts], rtol=1e-4)


def test_model_learns_and_base_is_exact(spark):
    rows = [(i, t) for i, t, _, _ in corpus(400, 5)] + [(r[0], r[1]) for r in edge.ROWS if r[0] not in (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id").selectExpr("id AS doc_id", "text", "1 AS block", "2 AS word", "3 AS held_out")
    got = lm.language_scores(df, tokenizer_file(), block_docs=64).collect()
    import zlib
    from collections import Counter
    from math import log10

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in (t or "").encode().lower().split())
    ends = sum(not held[i] for i, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws) + log10((ends + 1) / (n + v + 1))
        want.append((i, held[i], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base, 6)))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((*(r[k] for k in names), round(r["base_score"], 6)) for r in got) == sorted(want)
    trained = sum(r["score"] for r in got if r["held_out"])
    untrained = lm.language_scores(df, tokenizer_file(), block_docs=64, rounds=0)
    assert trained > 0.9 * sum(r["score"] for r in untrained.collect() if r["held_out"])  # nearer to 0: likelier


def test_model_edges(spark):
    got = lm.language_scores(edge.docs(spark), tokenizer_file())
    assert got.count() == len(edge.ROWS) and all(r["score"] < 0 for r in got.collect())
    assert lm.language_scores(edge.empty(spark), tokenizer_file()).count() == 0
    only_held = edge.docs(spark).where(lm.held_out("doc_id"))
    assert lm.language_scores(only_held, tokenizer_file()).count() == only_held.count()


def test_windows_cover_whole_texts():
    code = lm.coder(tokenizer_file())
    for n in (0, 1, 31, 32, 33, 5000):
        text = words(random.Random(n), "en", n)
        ids = np.frombuffer(code.encode(text), "<u4")
        rows = lm._rows(lm._chunks(text, code))
        z = [lm.MARK, *ids, lm.MARK]
        targets = rows[:, 1:].ravel()
        assert targets[targets >= 0].tolist() == z[1:] and rows[0, 0] == lm.MARK
        assert (rows[1:, 0] == rows[:-1, -1]).all()


def test_passes_do_not_depend_on_the_number_of_windows(monkeypatch):
    r, seen = np.random.default_rng(4), []
    counts = np.ones(lm.VOCABULARY)
    theta = lm.start(counts, lm.fold(counts))
    monkeypatch.setattr(lm, "gradient", lambda theta, x, y, used: (seen.append(len(x)), (0.0, np.zeros_like(theta)))[1])
    for n in (10, 700, 20_000):
        seen.clear()
        lm.train(theta, r.integers(0, lm.CLASSES, (n, lm.WINDOW + 1)), lm.PASSES, 0)
        assert sum(seen) == lm.PASSES * n


def test_ids_are_counted_over_whole_texts(spark):
    code = lm.coder(tokenizer_file())
    texts = [words(random.Random(i), "de", n) for i, n in enumerate((0, 3, 40, 3000))] + ["a\x1cb\u2003c d"]
    counts = np.zeros(lm.VOCABULARY)
    for t in texts:
        counts += np.bincount(np.frombuffer(code.whole(t), "<u4"), minlength=lm.VOCABULARY)
    counts[lm.MARK] += len(texts)
    df = spark.createDataFrame([(c,) for t in texts for c in lm._chunks(t, code)], "windows binary")
    classes, _ = lm.fit(df, rounds=0)
    want = lm.fold(counts)
    assert (classes.of == want.of).all() and np.allclose(classes.share, want.share)


def test_a_block_is_taken_in_parts(monkeypatch):
    """No task splits a whole block of texts at once or gives its windows in one batch; parts change no result."""
    import pyarrow as pa

    r = random.Random(6)
    texts = ["", "a\x1cb\u2003c d", words(r, "fr", 3000)] + [words(r, "en", r.randint(0, 60)) for _ in range(2500)]
    batch = pa.record_batch([pa.array([0] * len(texts), pa.int64()), pa.array(texts), pa.array([i % 7 == 2 for i in range(len(texts))])], names=["block", "text", "held_out"])
    batches = list(lm._gather(tokenizer_file())(iter([batch])))
    windows = [b.num_rows - b.column("windows").null_count for b in batches]
    assert sum(windows) > 2000 and max(windows) < 1100
    assert all(b.column("windows").null_count in (0, b.num_rows) for b in batches)

    gathered = pa.Table.from_batches(batches)
    seen = gathered.filter(pa.compute.is_valid(gathered["word"]))
    table = pa.table({"block": seen["block"], "word": seen["word"], "c": seen["n"]})
    docs = pa.table({"doc_id": range(len(texts)), "text": texts, "held_out": batch["held_out"]})
    counts = np.ones(lm.VOCABULARY)
    classes = lm.fold(counts)
    score = lm._score_block(tokenizer_file(), classes, lm.start(counts, classes), 5, 1000, 500)
    whole, split, sizes = score(docs, table), lm._split, []
    monkeypatch.setattr(lm, "PART_CHARS", 20_000)
    monkeypatch.setattr(lm, "PART_WORDS", 7)
    monkeypatch.setattr(lm, "_split", lambda t: (sizes.append((len(t), pa.compute.sum(pa.compute.binary_length(t)).as_py())), split(t))[1])
    parted = score(docs, table)
    assert len(sizes) > 5 and all(n == 1 or size <= 20_000 for n, size in sizes)
    assert whole.drop(["score"]) == parted.drop(["score"])
    assert np.allclose(whole["score"].to_numpy(), parted["score"].to_numpy(), rtol=1e-6)


def test_toxic_word_late_in_an_unbroken_run():
    """A word counts wherever it stands in a run without white space, and its span is where it is."""
    field = toxicity.fit(["you vileword here " + "calm words " * 5] * 12, ["calm words and more here you"] * 30)
    run = "-".join(["calm"] * 60) + "-vileword-" + "-".join(["more"] * 60)
    words_ = toxicity.words(run)
    assert len(run) > 300 and "vileword" in words_ and "".join(words_) == run
    emissions = toxicity._Emissions(field)
    p = toxicity.marginals([words_], field, emissions)[0]
    found = toxicity.spans(run, p)
    assert any(run[s["start"] : s["end"]].strip("-") == "vileword" for s in found)
    assert [run[a:b] for a, b in toxicity.word_places(run)] == words_ and toxicity.words("x" * 1000) == ["x" * 200] * 5


def test_language_is_learned_from_long_texts_and_by_every_language(spark):
    r = random.Random(8)
    rows = [(i, words(r, "en", 40), "en") for i in range(60)]
    rows += [(100 + i, words(r, "de", 9000), "de") for i in range(6)]  # long texts only
    rows += [(200 + i, "жзи " * 20 + chr(0x4E00 + i) * 30, f"x{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: r["n"] for r in langid.sample(df, 40).groupBy("lang").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert set(got) == {g for *_, g in rows} and max(len(r["text"]) for r in langid.sample(df, 40).collect()) <= langid.LEARN_CHARS
    model = langid.learn(df)
    pred = langid.predict(spark.createDataFrame([(words(r, "de", 60),)], "text string"), model).first()
    assert pred["lang_pred"] == "de"


def test_language_scores_against_plain_kernels():
    """The batched product equals kernels of sets of hashed n-grams, one pair at a time."""
    texts, langs = ["the thing and", "der die das ung", "le la eau tion", "the and ing", "das sch keit"], ["en", "de", "fr", "en", "de"]
    model = langid.fit(texts, langs, landmarks=4)

    def cells(text):
        out = np.zeros(langid.CELLS, np.float32)
        langid.profile(text, out)
        return set(np.flatnonzero(out).tolist())

    marks = [set(np.flatnonzero(m).tolist()) for m in model.landmarks]
    for text in ("the der", "eau", "zzz", *texts):
        mine = cells(text)
        kernel = np.array([len(mine & m) / np.sqrt(len(mine) * len(m)) for m in marks])
        assert np.allclose(model.scores([text])[0], kernel @ model.weights + model.offset, atol=1e-4)
