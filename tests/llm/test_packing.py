import os
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from crivo.llm import packing
from crivo.llm.queries import tokenizer_file
from crivo.llm.subwords import Coder

from . import edge

FILE = tokenizer_file()


def test_cut_fills_and_adds_up():
    for n in range(2048):
        pieces = packing.cut(n)
        assert sum(pieces) == n and len(pieces) <= 6
        for p in pieces:
            assert 2048 - 2048 // p * p <= max(packing.MAX_SLACK, 2048 // p)


def test_cached_ids_equal_the_tokenizer():
    import random

    r, coder = random.Random(3), Coder(FILE, max_words=50)
    letters = "aBz.,;!?'sdé ÉßİΣσς́ 　 \n\t\x1c12_-ñЖ中ªºʰ|<>😀​"
    for _ in range(2000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert coder.encode(t) == coder.whole(t), ascii(t)


def test_kept_words_are_bounded_and_frequent():
    coder, asked = Coder(FILE, max_words=100), []
    code = coder.known.code
    coder.known.code = lambda word: (asked.append(word), code(word))[1]
    coder.encode(" ".join(f"rare{i}" for i in range(1000)))
    assert len(coder.known) < 10  # a word met once is not kept
    for i in range(2000):
        assert coder.encode(f"often odd{i} odd{i}") == coder.whole(f"often odd{i} odd{i}")
        assert len(coder.known) + len(coder.known.older) <= 100
    assert asked.count("often") == 2


@pytest.mark.parametrize("capacity", [2048, 100])
def test_round_trip(spark, capacity):
    got = packing.pack(edge.docs(spark), FILE, capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = sorted(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in edge.ROWS)
    parts = defaultdict(list)
    for r in got:
        ids = struct.unpack(f"<{r['length']}I", r["ids"])
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    whole = defaultdict(list)
    for ids in want:
        whole[len(ids)].append(ids)
    for (_, n), pieces in parts.items():  # rows that repeat an identifier give the same pieces
        by_start = dict(pieces)
        ids = [i for s in sorted(by_start) for i in by_start[s]]
        assert len(ids) == n and ids in whole[n]
    assert sum(r["length"] for r in got) == sum(map(len, want))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_empty(spark):
    assert packing.pack(edge.empty(spark), FILE).count() == 0


def test_tokenising_tasks_need_no_pandas():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import sys, crivo.llm.packing; print('pandas' in sys.modules)"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert said.stdout.strip() == "False", said.stderr
