"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

A signature has `coordinates` values, each the minimum of one hash function over a text's word shingles. A document is
posted under its (coordinate, value) pairs. Two documents match when they share at least a threshold of pairs, which
is set so that documents at the similarity asked for miss it 3 times in a million at most.

* **Prefix.** Pairs are put into one global order, rare ones first by a count sketch of fixed size. Documents sharing
  the match threshold of pairs must meet within their first coordinates - threshold + 1, so only those are posted, and a
  passage that half the corpus quotes is posted only by documents that consist of little else.
* **Skip.** Merging a posting list, a document found to match is set aside and never compared again: the list's matches
  are walked breadth first, each visited document is compared with the unvisited ones only, and the list gives one
  edge per document found, not one per pair. A list of near copies costs little more than its length.
* **Confirm.** Families joined by these edges are walked the same way on their full shingle sets. Only documents of
  one family can be linked, so no link between different texts is lost, and again one edge per document comes out.

Equal sets are folded to their smallest doc_id before anything else. Lists and families above a size limit are cut
into blocks and every pair of blocks is walked, so no task holds an unbounded group and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crivo.llm.components import components
from crivo.llm.prefilter import drop_absent
from crivo.session import materialise, ship

COORDINATES = 64
SHINGLE = 5
SKETCH_BITS = 18
LIST_BLOCK = 4096  # documents of a posting list in one cell
FAMILY_BLOCK = 1 << 20  # shingles of a family in one cell

U = np.uint64
_SIGNED = "doc_id long, n_shingles long, node long, other long, signature binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _WordHash(dict):
    """64-bit hashes of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh64_digest

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxh64_digest(word)
        return h


def shingles(text: str | None, words: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's `size`-word shingles; of all its words together if it has fewer."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, U)
    h = np.frombuffer(b"".join(map(words.__getitem__, parts)), U)
    step = min(size, len(h))
    out = np.zeros(len(h) - step + 1, U)
    for j in range(step):
        out = _mix(out + h[j : len(h) - step + 1 + j] + U(j + 1))
    return np.unique(out)


def _set_numbers(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit numbers for a set: its name, and the one that tells sets of one name apart."""
    one, two = (_mix(_mix(x).sum(dtype=U, keepdims=True)).view(np.int64)[0] for x in (hashes + U(1), hashes ^ U(0x9E3779B97F4A7C15)))
    return int(one), int(two)


def match_threshold(coordinates: int, percent: int, miss: float = 3e-6) -> int:
    """The largest number of matching coordinates that a pair of similarity `percent` falls short of with chance `miss`."""
    p, below = percent / 100, 0.0
    for least in range(coordinates + 1):
        below += comb(coordinates, least) * p**least * (1 - p) ** (coordinates - least)
        if below > miss:
            return max(1, least)
    return coordinates


def _multipliers(coordinates: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, coordinates, dtype=U) | U(1)


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest high half of hash x multiplier, per multiplier."""
    out = np.full(len(multipliers), 0xFFFFFFFF, U)
    for lo in range(0, len(hashes), 4096):
        np.minimum(out, (hashes[lo : lo + 4096, None] * multipliers >> U(32)).min(0), out=out)
    return out.astype("<u4")


def _arrow(schema: list[tuple[str, pa.DataType]], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


def _sign(coordinates: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by = _WordHash(), _multipliers(coordinates)
        schema = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("signature", pa.binary())]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1]):
                s = shingles(text.as_py(), words, size)
                rows.append((doc_id, len(s), *_set_numbers(s), signature(s, by).tobytes()))
            if rows:
                yield _arrow(schema, list(zip(*rows)))

    return run


def _pairs_of(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit number per (coordinate, value)."""
    return _mix((signatures.astype(U) << U(8)) + np.arange(signatures.shape[1], dtype=U))


def _read(column: pa.Array | pa.ChunkedArray, coordinates: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, coordinates)


def _sketch(coordinates: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                at = _pairs_of(_read(batch[0], coordinates, "<u4")) >> U(64 - bits)
                total += np.bincount(at.ravel().astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield _arrow([("cell", pa.int32()), ("n", pa.int64())], [used, total[used]])

    return run


def _post(coordinates: int, least: int, bits: int, counts: np.ndarray):
    prefix = coordinates - least + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = _pairs_of(_read(batch[1], coordinates, "<u4"))
            first = np.lexsort((pairs, counts[(pairs >> U(64 - bits)).astype(np.int64)]), axis=1)[:, :prefix]
            posted = np.take_along_axis(pairs, first, 1).ravel().view(np.int64)
            yield _arrow([("pair", pa.int64()), ("node", pa.int64())], [posted, np.repeat(batch[0].to_numpy(), prefix)])

    return run


def walk(n: int, near: Callable[[int, np.ndarray], np.ndarray], sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over items 0..n-1. `near(i, js)` tells which of the items js are linked to i.

    With `sides` (0 or 1 per item) only pairs across the two sides are looked at.
    """
    left = np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = np.ones(len(left), bool) if sides is None else sides[left] != sides[i]
            if hit.any():
                hit[hit] = near(i, left[hit])
                found, left = left[hit], left[~hit]
                queue.extend(found)
                yield from ((int(i), int(j)) for j in found)


def _sized(sizes: np.ndarray, i: int, js: np.ndarray, percent: int) -> np.ndarray:
    """Set sizes that leave room for the similarity asked for."""
    return 100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal values in the first `width` columns, which are sorted; one run in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch[i].to_numpy() for i in range(width)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(keys[lo])
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def _column(run: list[pa.RecordBatch], name: str) -> pa.ChunkedArray:
    return pa.chunked_array([b.column(name) for b in run])


_EDGE = [("a", pa.int64()), ("b", pa.int64())]


def _sides(run: list[pa.RecordBatch]) -> np.ndarray | None:
    side = _column(run, "side").to_numpy()
    return None if (side < 0).all() else side


def _merge_lists(coordinates: int, least: int, percent: int):
    """Edges between documents of one cell of a posting list that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, 3):
            ids = _column(cell, "node").to_numpy()
            sizes = _column(cell, "n_shingles").to_numpy()
            marks = _read(_column(cell, "signature"), coordinates, "<u4")

            def near(i: int, js: np.ndarray) -> np.ndarray:
                fits = _sized(sizes, i, js, percent)
                if fits.any():
                    fits[fits] = (marks[js[fits]] == marks[i]).sum(1) >= least
                return fits

            edges = list(walk(len(ids), near, _sides(cell)))
            if edges:
                e = np.array(edges)
                yield _arrow(_EDGE, [ids[e[:, 0]], ids[e[:, 1]]])

    return run


def _confirm(percent: int):
    """Edges between documents of one cell of a family whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, 3):
            ids = _column(cell, "node").to_numpy()
            sets = [np.frombuffer(x.as_py(), U) for x in _column(cell, "shingles")]
            sizes = np.array([len(s) for s in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            present = np.zeros(flat.max() + 1, bool)

            def near(i: int, js: np.ndarray) -> np.ndarray:
                fits = _sized(sizes, i, js, percent)
                ask = js[fits]
                if len(ask):
                    present[parts[i]] = True
                    starts = np.cumsum(sizes[ask]) - sizes[ask]
                    common = np.add.reduceat(present[np.concatenate([parts[j] for j in ask])], starts, dtype=np.int64)
                    present[parts[i]] = False
                    fits[fits] = 100 * common >= percent * (sizes[ask] + sizes[i] - common)
                return fits

            edges = list(walk(len(ids), near, _sides(cell)))
            if edges:
                e = np.array(edges)
                yield _arrow(_EDGE, [ids[e[:, 0]], ids[e[:, 1]]])

    return run


def _shingle(size: int):
    """The shingle set of each row's text, if it is the set that the row's node names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        schema = [("family", pa.int64()), ("node", pa.int64()), ("blocks", pa.int64()), ("shingles", pa.binary())]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for family, node, blocks, text in zip(*(batch.column(i)[lo : lo + 256] for i in range(4))):
                    s = shingles(text.as_py(), words, size)
                    if node.as_py() in _set_numbers(s):
                        rows.append((family.as_py(), node.as_py(), blocks.as_py(), s.tobytes()))
                if rows:
                    yield _arrow(schema, list(zip(*rows)))

    return run


def _cells(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Deal each group into cells: one if its `blocks` is 1, else every block with itself and with every other block.

    `side` is -1 within a block, else 0 or 1 for the two blocks of the cell.
    """
    cells = F.expr(
        "transform(sequence(0, cast(blocks as int) - 1), i -> struct("
        "least(i, block) AS low, greatest(i, block) AS high, "
        "CASE WHEN i = block THEN -1 WHEN i > block THEN 0 ELSE 1 END AS side))"
    )
    dealt = rows.withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int")).withColumn("cell", F.explode(cells))
    out = dealt.select(key, F.col("cell.low").alias("low"), F.col("cell.high").alias("high"), "node", F.col("cell.side").alias("side"), *columns)
    return out.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def _told_apart(signed: DataFrame) -> DataFrame:
    """`signed` with different sets under different names.

    Among many sets two may agree in 64 bits by chance. Sets are equal only if their size and both numbers agree; of those that
    share a name, all but the first take their second number for it.
    """
    distinct = signed.where("n_shingles > 0").groupBy("node", "n_shingles", "other").agg(F.lit(1).alias("one"))
    shared = distinct.groupBy("node").agg(F.count("*").alias("sets"), F.min(F.struct("n_shingles", "other")).alias("first")).where("sets > 1")
    shared = materialise(shared, "shared-names")
    if shared.isEmpty():
        return signed
    renamed = signed.join(F.broadcast(shared) if shared.count() <= 100_000 else shared, "node", "left")
    name = F.when(F.col("first").isNotNull() & (F.col("first") != F.struct("n_shingles", "other")), F.col("other")).otherwise(F.col("node"))
    return materialise(renamed.withColumn("node", name).select(signed.columns), "signed-apart")


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    coordinates: int = COORDINATES,
    least: int | None = None,
    size: int = SHINGLE,
    sketch_bits: int = SKETCH_BITS,
    list_block: int = LIST_BLOCK,
    family_block: int = FAMILY_BLOCK,
) -> DataFrame:
    """Link documents whose `size`-word shingle sets have a Jaccard similarity of at least `percent` hundredths.

    One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links, itself included) and kept (doc_id = component_id). Letters A-Z are lower-cased, words are separated by the
    six ASCII white-space characters; a text with fewer words is one shingle. A null, empty or blank text has no set,
    is linked with nothing and stays. Equal sets are always linked. A row with a null doc_id is linked like any other,
    names no group, and stays only where no row of its group has a doc_id. Rows that repeat a doc_id are judged each by
    its own text; those with equal sets share the decision. Other columns are ignored. An empty table gives no rows.
    `least` is the match threshold; by default the largest one that pairs at `percent` miss 3 times in a million at most.
    """
    ship(docs.sparkSession)
    least = least or match_threshold(coordinates, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(rows.mapInArrow(_sign(coordinates, size), _SIGNED), "signed")
    # one row per distinct set: its first document stands for it
    signed = _told_apart(signed)
    found = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"))
    sets = materialise(found, "sets")
    lead = signed.join(sets.select("node", "first_id"), "node").where("doc_id <=> first_id")
    lead = materialise(lead.select("node", "n_shingles", "signature").dropDuplicates(["node"]), "leads")

    counts = np.zeros(1 << sketch_bits, np.int64)
    cells = lead.select("signature").mapInArrow(_sketch(coordinates, sketch_bits), "cell int, n long")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** sketch_bits rows
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    posted = lead.select("node", "signature").mapInArrow(_post(coordinates, least, sketch_bits, counts), "pair long, node long")
    posted = materialise(posted, "postings")
    lists = posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    lists = lists.select("pair", F.expr(f"(n + {list_block - 1}) div {list_block}").alias("blocks"))
    marked = posted.join(lists, "pair").join(lead, "node")
    edges = _cells(marked, "pair", "n_shingles", "signature").mapInArrow(_merge_lists(coordinates, least, percent), "a long, b long")
    families = components(edges, "family-edges").withColumnRenamed("component", "family")

    members = materialise(families.join(sets, "node"), "families")
    volume = members.groupBy("family").agg(F.sum("n_shingles").alias("volume"))
    volume = volume.select("family", F.expr(f"(volume + {family_block - 1}) div {family_block}").alias("blocks"))
    members = members.join(volume, "family").select(F.col("first_id").alias("doc_id"), "node", "family", "blocks")
    rows = drop_absent(rows, members, "doc_id")
    texts = rows.join(members, rows["doc_id"].eqNullSafe(members["doc_id"])).select("family", "node", "blocks", "text")
    full = texts.mapInArrow(_shingle(size), "family long, node long, blocks long, shingles binary")
    linked = components(_cells(full, "family", "shingles").mapInArrow(_confirm(percent), "a long, b long"), "links")
    linked = linked.join(sets, "node")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "component").select("node", "component_id")

    out = signed.select("doc_id", "n_shingles", "node").join(sets.select("node", "first_id"), "node", "left").join(linked, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "first_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))
