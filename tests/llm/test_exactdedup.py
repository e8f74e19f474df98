import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crivo.llm import exactdedup
from crivo.session import scratch

from . import edge


def want(rows):
    """Multiset of (doc_id, keep_id, group_size, text_sha256), and the number of rows kept."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc_id, keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for doc_id, _ in members]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary")])
def test_edges_also_when_digests_collide(spark, digest):
    rows = [(r[0], r[1]) for r in edge.ROWS]
    rows += [(100 + i, f"t e x t{i % 37}" + " " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(edge.ROWS, edge.SCHEMA).unionByName(
        spark.createDataFrame(rows[len(edge.ROWS):], "doc_id long, text string"), allowMissingColumns=True
    )
    got = exactdedup.deduplicate(df, digest).collect()
    rows_out = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr)
    expected, groups = want(rows)
    assert rows_out == expected
    assert sum(r["kept"] for r in got) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_keep_returns_whole_rows(spark, tmp_path):
    edge.docs(spark).write.parquet(f"{tmp_path}/d")
    kept = exactdedup.keep(spark.read.parquet(f"{tmp_path}/d"))
    assert kept.columns == edge.docs(spark).columns
    assert kept.count() == want([(r[0], r[1]) for r in edge.ROWS])[1]
    assert exactdedup.deduplicate(edge.empty(spark)).count() == 0


def test_state_takes_in_new_files_only(spark, tmp_path):
    schema = "digest binary, doc_id long, points int, locator struct<file: string, row: long>"
    state = scratch(spark, "state")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for part, ids in enumerate(([1, 2, 3], [4, 2])):
        rows = [(bytes([i % 2]), i, 10 + (i == 4), (f"f{part}", i)) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        exactdedup.fold_stream(stream(), state)
    held = {r["digest"][0]: (r["stay"]["doc_id"], r["group_size"]) for r in exactdedup.read_state(spark, state).collect()}
    assert held == {1: (1, 2), 0: (4, 3)}
