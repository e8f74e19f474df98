import random
from collections import defaultdict

import numpy as np
import pytest

from crivo.llm import neardup

from . import edge


def brute(rows, percent):
    """doc_id, n_shingles, component and kept for every row, from all pairs of sets."""
    sets = []
    for _, text in rows:
        w = text.encode().lower().split() if text else []
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in groups[find(i)] if x is not None]
        component = min(known) if known else None
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def planted():
    r = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [r.choice(words) for _ in range(r.randint(30, 160))]
        for _ in range(r.choice([1, 1, 2, 6, 30])):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(words)
            at = r.randrange(len(w))
            rows.append(w[:at] + passage + w[at:] if r.random() < 0.1 else w)
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("limits", [{}, {"list_block": 4, "family_block": 500}])
def test_against_all_pairs(spark, limits):
    rows = planted()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, **limits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 85)


def test_edges(spark):
    got = neardup.near_duplicates(edge.docs(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute([(r[0], r[1]) for r in edge.ROWS], 80)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert neardup.near_duplicates(edge.empty(spark)).count() == 0


def test_threshold_and_walk():
    assert neardup.match_threshold(64, 85) == 40
    near = np.zeros((7, 7), bool)
    for i, j in ((0, 3), (3, 5), (1, 2)):
        near[i, j] = near[j, i] = True
    assert len(list(neardup.walk(7, lambda i, js: near[i, js]))) == 3


def test_sets_with_one_name_are_told_apart(spark, monkeypatch):
    """All sets get the same first number: the second one and the size still keep them apart."""
    real = neardup._set_numbers
    rows = [(i, f"a{i // 2} b c d e f g h{i // 4}") for i in range(12)] + [(20, "one two"), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = [(i, len(s), 77, real(s)[1], b"") for i, t in rows for s in [neardup.shingles(t, neardup._WordHash())]]
    table = spark.createDataFrame(signed, neardup._SIGNED)
    got = {r["doc_id"]: r["node"] for r in neardup._told_apart(table).collect()}
    sets = {i: frozenset(neardup.shingles(t, neardup._WordHash()).tolist()) for i, t in rows if t}
    assert all((got[i] == got[j]) == (sets[i] == sets[j]) for i in sets for j in sets)
    assert neardup._told_apart(table.where("doc_id = 20")).first()["node"] == 77
    assert docs.count() == len(rows)


def test_long_chain_and_star(spark):
    from crivo.llm.components import components

    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1800)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star, "a long, b long")).collect()))
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1800)} == {1000}
