import base64
import gzip
import hashlib
import os

import pytest

from crivo.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, key string, kind int"
ROWS = [
    (5, "http://a/1", "<p>same</p>", 1, "k", 9),
    (9, "http://a/2", "<p>same</p>", 1, "k", 9),
    (7, None, "<p>same</p>", 1, "k", 9),
    (7, None, "<p>same</p>", 1, "k", 9),
    (1, "http://b/ x\r\n", "é" * 70_000, 1, "k", 9),
    (2, "http://c", None, 1, "k", 9),
    (3, "http://c", "", 1, "k", 9),
    (None, "http://d", "nameless", 1, "k", 9),
    (None, "http://d", "<p>same</p>", 1, "k", 9),
    (4, "http://e", "a\r\n\r\nb", None, None, None),
]


def want(rows, least=0):
    out = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        top = max(same) if same and len(body) >= least else None
        again = top is not None and top != page_id
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, tmp_path, least):
    uri = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), uri, min_revisit=least)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    got = warc.read_archives(spark, uri)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == want(ROWS, least)
    html = {r["payload"].decode() for r in got.where("record_type = 'response'").collect()}
    assert html == {r[2] or "" for r in ROWS}
    assert not os.path.exists(f"{tmp_path}/warc/_temporary")


def test_same_files_however_many_tasks(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i % 40} body " * (i % 300), 0, "", 0) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = []
    for n in (1, 5):
        uri = f"file://{tmp_path}/w{n}"
        m = warc.write_archives(df.repartition(n), uri, shard_bytes=200_000, roll_bytes=4_000)
        found.append(sorted((r["file"], r["bytes"], r["sha1"]) for r in m.collect()))
        assert sorted((tuple(r) for r in warc.read_archives(spark, uri, False).select(COLUMNS).collect()), key=repr) == want(rows)
    assert found[0] == found[1] and len({f[:12] for f, _, _ in found[0]}) > 2 and len(found[0]) > 5
    name = f"{tmp_path}/w1/{found[0][0][0]}"
    assert gzip.open(name).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_empty_and_damaged(spark, tmp_path):
    uri = f"file://{tmp_path}/none"
    assert warc.write_archives(spark.createDataFrame([], SCHEMA), uri).count() == 0
    assert warc.read_archives(spark, uri).count() == 0
    with pytest.raises(ValueError):
        list(warc.members(open(__file__, "rb")) if False else warc.members(_Cut()))


class _Cut:
    data = gzip.compress(b"x" * 5000 + os.urandom(5000))[:-100]

    def read(self, n):
        out, self.data = self.data, b""
        return out
