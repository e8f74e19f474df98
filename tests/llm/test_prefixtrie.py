"""The prefix trie against a trie built in memory."""

import hashlib
import random
import re
import zlib

from crivo.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, place long, words string, depth int"


def order(turn, role, text):
    return (turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def conversations(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out.setdefault(c, []).append((order(turn, role or "", text or ""), role or "", text or ""))
    return {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in out.items()}


def graft(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = c % 20 if c >= 0 else -(-c % 20)
        out[c] = convs.get(c - rest, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    total = {}
    for n in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        below = [total[k] for k in children.get(n, [])]
        total[n] = (sum(b[0] for b in below) or 1, (len(nodes[n]) - 1) * words + sum(b[1] for b in below))
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(n))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), parent, len(members), len(children.get(n, [])), *total[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, -1, "x", 9) for r in rows], SCHEMA)


def made(seed=3, n=130, longest=9):
    """Few different turns, so that beginnings are shared; one conversation is long, one group ends together."""
    r, rows = random.Random(seed), []
    for c in [*range(n), -3, -20, -25, 1_000_000_007]:
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "a  b\x0bc", "é", "", None])))
    rows += [(n + 1, t, "user", f"w{t % 7}") for t in range(150)] + [(n + 2, t, "user", f"w{t % 7}") for t in range(140)]
    rows += [(1000 + c, 0, "user", "all the same") for c in range(600)]
    return rows


def check(spark, rows, height=16):
    turns = prefixtrie.numbered(table(spark, rows))
    got = prefixtrie.trie(*prefixtrie.regrafted(turns), height=height)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(graft(conversations(rows)))


def test_against_brute_force(spark):
    check(spark, made())


def test_low_bands_take_several_rounds(spark):
    check(spark, made(4, 40), height=3)  # 150 turns: five levels of bands


def test_edges(spark):
    rows = [
        (7, None, "user", "null number comes first"), (7, 0, "user", "x"), (7, 0, "user", "y"), (7, 0, "user", "x"),
        (8, 0, None, None), (8, 1, "", ""), (None, 0, "user", "nobody's"), (None, None, None, None),
        (40, 5, "user", "long " * 20_000), (41, 1, "user", "b"), (41, 1, "user", "b"), (42, -1, "u", "ser"), (43, -1, "us", "er"),
    ]
    check(spark, rows)
    empty = prefixtrie.numbered(table(spark, []))
    assert prefixtrie.trie(*prefixtrie.regrafted(empty)).collect() == []


def test_without_grafts_and_hot_parent(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c}") for c in range(3000) for t in range(2)]
    turns = prefixtrie.numbered(table(spark, rows))
    got = prefixtrie.trie(turns, turns.select("conv_id").distinct())
    assert sorted(map(tuple, got.collect()), key=repr) == brute(conversations(rows))


def test_places_of_a_conversation_over_many_ranges(spark):
    rows = [(1, 5000 - t, "user", str(t)) for t in range(5000)] + [(2, 0, "user", "z")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixtrie.numbered(table(spark, rows)).groupBy("conv_id").agg({"place": "max", "*": "count"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == [(1, 5000, 5000), (2, 1, 1)]
