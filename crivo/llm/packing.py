"""Harmonic packing of token sequences into fixed-capacity training sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of about capacity / k tokens and a bin of class k
takes exactly k of them, whatever else is packed. So every worker numbers its own pieces per class, and a small table
of counts per (task, class) turns these into bin numbers; no bin depends on another class or on the order of the tasks.

Documents may be cut. A document gives whole sequences first; its remainder r goes to class k = capacity // r when k
such pieces leave at most `max_slack` tokens of a bin unused, else it is cut at capacity // (k + 1), which fills class
k + 1 exactly, and the rest is treated alike. Only the last bin of each length can stay part-filled. Those pieces
number less than capacity * (1 + ln capacity), whatever the input, and are packed first-fit decreasing in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from crivo.llm.subwords import coder
from crivo.session import materialise, release, ship

CAPACITY = 2048
END = 1
MAX_SLACK = 32
PIECES = "doc_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long, task int, number long"


@lru_cache(maxsize=None)
def cut(length: int, capacity: int = CAPACITY, max_slack: int = MAX_SLACK) -> tuple[int, ...]:
    """Piece lengths, in order, of a remainder shorter than the capacity."""
    out: list[int] = []
    while length:
        k = capacity // length
        if capacity - k * length <= max_slack:
            return (*out, length)
        out.append(capacity // (k + 1))
        length -= out[-1]
    return tuple(out)


def _pieces(tokenizer: str, capacity: int, end: int, max_slack: int):
    closing = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = coder(tokenizer), TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("number", pa.int64())])
        count: dict[int, int] = defaultdict(int)
        cols: list[list] = [[] for _ in schema]
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1]):
                ids = code.encode(text.as_py()) + closing
                n = len(ids) // 4
                start = 0
                for length in (capacity,) * (n // capacity) + cut(n % capacity, capacity, max_slack):
                    part = ids[4 * start : 4 * (start + length)]
                    for col, v in zip(cols, (doc_id, start, length, part, zlib.crc32(part), n, task, count[length])):
                        col.append(v)
                    count[length] += 1
                    start += length
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols, held = [[] for _ in schema], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        release()

    return run


def _first_fit(capacity: int):
    """Bins for the pieces of part-filled bins: longest first, each into the first bin with room.

    The pandas frame's type is not named: the tasks that tokenise load this module too and need no pandas.
    """

    def run(rows):
        rows = rows.sort_values(["length", "place"], ascending=[False, True], ignore_index=True)
        room: list[int] = []
        bins, offsets = [], []
        for length in rows["length"]:
            at = next((i for i, r in enumerate(room) if r >= length), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            offsets.append(capacity - room[at])
            room[at] -= length
        return rows.assign(loose_bin=bins, loose_offset=offsets)[["length", "place", "loose_bin", "loose_offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, max_slack: int = MAX_SLACK) -> DataFrame:
    """Pack the column `text` of `docs` into sequences of at most `capacity` tokens.

    One row per piece: doc_id, start (tokens of the document before it), length, ids (little-endian unsigned 32-bit),
    ids_crc32, doc_tokens, sequence_id, offset (position in the sequence, gapless from 0). A document is the ids of its
    text and then `end`; a null or empty text is `end` alone. Rows with a null or repeated doc_id are documents of
    their own. Any other columns are ignored. An empty table gives no rows. Equal lengths are ties and are numbered by
    task and row order. `tokenizer` is a file of the `tokenizers` library, readable on every worker.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, capacity, end, max_slack), PIECES), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task")
    bases = counts.select(
        "task",
        "length",
        (F.sum("n").over(before) - F.col("n")).alias("base"),
        F.sum("n").over(W.partitionBy("length")).alias("total"),
    )
    bases = bases.withColumn("per_bin", F.expr(f"cast({capacity} as long) div length")).withColumn("full", F.expr("total - total % per_bin"))
    placed = pieces.join(bases, ["task", "length"]).withColumn("place", F.col("base") + F.col("number"))
    ends = bases.groupBy("length").agg(F.max("full").alias("full"), F.max("total").alias("total")).where("full < total")
    loose = ends.select("length", F.explode(F.expr("sequence(full, total - 1)")).alias("place"))
    layout = loose.groupBy().applyInPandas(_first_fit(capacity), "length int, place long, loose_bin long, loose_offset long")
    placed = placed.withColumn("loose", F.expr("place >= full")).join(F.broadcast(layout), ["length", "place"], "left")
    width = capacity + 1
    return placed.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids",
        "ids_crc32",
        "doc_tokens",
        F.when(F.col("loose"), F.col("loose_bin") * width)
        .otherwise(F.expr("place div per_bin") * width + F.col("length"))
        .cast("long")
        .alias("sequence_id"),
        F.when(F.col("loose"), F.col("loose_offset")).otherwise(F.expr("place % per_bin * length")).cast("long").alias("offset"),
    )
