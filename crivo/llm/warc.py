"""Deterministic sharded WARC archives: write, commit, read back.

* **Shards** are ranges of the record identifier. Their bounds are cut from a sample chosen by hash, so the same
  records give the same shards whatever the number of tasks.
* **Files** of a shard roll over once their compressed size passes a limit. Each record is a gzip member of its own.
* **Headers** are made anew from the payload: lengths, SHA-1 digests of payload and block, identifiers. Of records with
  equal payloads the one with the largest identifier is a response, the others are revisits that refer to it.
* **Commit.** A task writes under a temporary name that no other attempt uses and returns a manifest row per file. The
  manifest holds only rows of successful attempts; a second job renames exactly these files, and the manifest
  that it leaves is the sign that the archive is complete. Readers open only what the manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from crivo.session import materialise, ship

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
SAMPLE = 10_000
URN = "urn:crivo:page:"
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = [("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]
_MANIFEST_SQL = "file string, temporary string, records long, bytes long, sha1 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, fields: dict[str, str], block: bytes, date: str = DATE) -> bytes:
    """One WARC record, uncompressed."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{uri}>", "WARC-Date": date, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """The record of a page; `payload` is None for a revisit, which carries the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields = {"WARC-Target-URI": "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "")}
    fields |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    fields |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}"}
    if payload is None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        fields |= {"WARC-Refers-To": f"<{URN}{refers_to}>"}
    return record("response" if payload is not None else "revisit", f"{URN}{page_id}", fields, block, date)


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Roller:
    """The files of one shard, one open at a time."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, attempt: str, roll_bytes: int):
        self.store, self.folder, self.shard, self.attempt, self.roll_bytes = store, folder, shard, attempt, roll_bytes
        self.part, self.out, self.rows = -1, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.part += 1
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha1 = 0, -1, hashlib.sha1()
            info = f"software: crivo\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self.add(record("warcinfo", f"urn:crivo:file:{self.name}", {"Content-Type": "application/warc-fields"}, info))
        data = _gzip(data)
        self.out.write(data)
        self.sha1.update(data)
        self.bytes += len(data)
        self.records += 1
        if self.bytes >= self.roll_bytes and self.records:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.rows.append((self.name, self.temporary, self.records, self.bytes, self.sha1.hexdigest()))


def _write(uri: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.taskAttemptId()}"
        roller, origin = None, None
        for batch in batches:
            for shard, page_id, key, kind, url, html, refers_to in zip(*(batch.column(i) for i in range(7))):
                if roller is None or roller.shard != shard.as_py():
                    if roller:
                        roller.close()
                        yield from _rows(roller.rows)
                    roller = _Roller(store, folder, shard.as_py(), attempt, roll_bytes)
                at = (page_id.as_py(), key.as_py())
                if kind.as_py() == 0:  # says that the pages with this identifier and payload are revisits
                    origin = (at, refers_to.as_py())
                    continue
                payload = html.as_py().encode()
                digest = base32_sha1(payload)
                again = origin is not None and origin[0] == at
                roller.add(page_record(at[0], url.as_py(), None if again else payload, len(payload), digest, origin[1] if again else None))
        if roller:
            roller.close()
            yield from _rows(roller.rows)

    return run


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _MANIFEST)], names=[n for n, _ in _MANIFEST])


def _rename(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(n).to_pylist() for n in ("file", "temporary", "bytes"))):
                there = store.get_file_info(f"{folder}/{name}")
                if there.type != fs.FileType.File or there.size != size:  # else an earlier attempt has renamed it
                    store.move(f"{folder}/{temporary}", f"{folder}/{name}")
            yield batch

    return run


def _bounds(rows: DataFrame, shard_bytes: int) -> list[int]:
    """Largest identifiers of all shards but the last."""
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    shards = -(-(total or 0) // shard_bytes)
    if shards < 2:
        return []
    some = rows.where(f"page_id IS NOT NULL AND pmod(xxhash64(page_id), {max(1, n // SAMPLE)}) = 0")
    got = some.groupBy("page_id").agg(F.sum("size").alias("size")).orderBy("page_id").collect()  # about SAMPLE rows
    weight = sum(r["size"] for r in got) / shards
    bounds, held = [], 0
    for r in got:
        held += r["size"]
        if held >= weight * (len(bounds) + 1) and len(bounds) < shards - 1:
            bounds.append(r["page_id"])
    return sorted(set(bounds))


def write_archives(pages: DataFrame, uri: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = 0) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) to WARC files under `uri`; return the manifest.

    The payload is the html in UTF-8; null is empty. Payloads of at least `min_revisit` bytes are written once, in the
    record with the largest page_id; the other records with that payload are revisits. Rows are ordered by page_id,
    null first; a null page_id never is a revisit's target while another one is there. Rows that repeat page_id and payload are of the
    same kind. A null url is an empty one. Other columns are ignored. An empty table gives an empty manifest. `uri` must
    be reachable by pyarrow on every worker.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    narrow = materialise(rows.select("page_id", "key", F.octet_length("html").cast("long").alias("bytes"), (F.octet_length("html") + 600).cast("long").alias("size")), "warc-keys")
    origins = narrow.where(F.col("bytes") >= min_revisit).groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    revisits = narrow.join(origins.where("n > 1 AND refers_to IS NOT NULL"), "key").where("NOT page_id <=> refers_to")
    revisits = revisits.select("page_id", "key", "refers_to").distinct()

    bounds = _bounds(narrow, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(bounds, -(1 << 63) if i != i or i is None else int(i)) for i in ids.astype(object)])

    both = rows.select("page_id", "key", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    both = both.union(revisits.select("page_id", "key", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "refers_to"))
    both = both.withColumn("shard", shard_of(F.col("page_id").cast("string")))
    both = both.select("shard", "page_id", "key", "kind", "url", "html", "refers_to")
    both = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "key", "kind", "url")
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(f"{folder}/_temporary", recursive=True)
    staged = both.mapInArrow(_write(uri, roll_bytes), _MANIFEST_SQL)
    staged.write.mode("overwrite").parquet(f"{uri}/_staged")
    staged = spark.read.schema(_MANIFEST_SQL).parquet(f"{uri}/_staged")
    staged.mapInArrow(_rename(uri), _MANIFEST_SQL).drop("temporary").write.mode("overwrite").parquet(f"{uri}/manifest")
    store.delete_dir(f"{folder}/_temporary")  # what failed attempts left
    return read_manifest(spark, uri)


def read_manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema("file string, records long, bytes long, sha1 string").parquet(f"{uri}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    rest = b""
    while True:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if out:
                    raise ValueError("the file ends inside a member")
                return
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


_PAGES = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _identifier(field: str) -> int | None:
    name = field.removeprefix(f"<{URN}").removesuffix(">")
    return None if name == "None" else int(name)


def _read(uri: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: wrong block digest in {fields['WARC-Record-ID']}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and (digest != base32_sha1(payload) or size != len(payload)):
                            raise ValueError(f"{name}: wrong payload in {fields['WARC-Record-ID']}")
                        refers_to = None if response else _identifier(fields["WARC-Refers-To"])
                        rows.append((_identifier(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload if payloads and response else None, size, digest, fields["WARC-Type"], refers_to))
                        held += len(payload) if payloads else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PAGES)], names=[n for n, _ in _PAGES])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PAGES)], names=[n for n, _ in _PAGES])

    return run


def read_archives(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """The page records of the committed files under `uri`, checked against their digests.

    page_id, url, payload (null for revisits, and when `payloads` is false), payload_bytes and payload_digest of the full
    payload, record_type, refers_to. Files are read as streams, one record in memory at a time.
    """
    ship(spark)
    files = read_manifest(spark, uri).select("file")
    files = files.repartition(max(1, min(files.count(), 100_000)), "file")
    return files.mapInArrow(_read(uri, payloads), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
