"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct word shingles. Equal sets are one node. Of each node's minhashes a tree takes DEPTH in
turn as a key, and the nodes of each tree are sorted by it. In a sorted order the nodes with the longest common prefix
stand together: a node's candidates are its neighbours that share at least ``LEAST`` values. In dense regions the
neighbours share long prefixes and in sparse ones short prefixes, so the depth adapts by itself. The orders are
range-partitioned, which splits regions of any size.

Candidates pass a sketch of one bit per minhash and the size bound, and are confirmed on full sets. To verify few
pairs, each node's best candidate comes first; then, of all others, those between nodes not yet connected.

A region is all nodes that share a tree's first LEAST values. At last each pair of nodes of a region that are of
different components is compared: regions are dealt out in blocks of both sides, whatever their size, and not by places
in an order. What passes the sketches is confirmed on full sets inside the block, so only links leave it, and no pairs
that fail are written, however many a family of similar texts has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import freeing, slices, stored, table, temporary

TREES, DEPTH, LEAST = 16, 8, 3
#: Neighbours looked at in each order at first, before and behind.
WINDOW = 16
#: Nodes of a region that meet in one block, of each side, and pairs of nodes that are compared at a time.
BLOCK, PAIRS_AT_ONCE = 2048, 1 << 18
#: Bytes of texts of one block on average, when pairs are confirmed, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 1 << 23, 8
#: Shingles of the nodes of one block, of each side, in the search between components.
BLOCK_SHINGLES = 1 << 21
#: Rows of an order that a task searches at a time, besides the window before them.
STRETCH, STRETCH_BYTES = 10_000, 32 << 20
#: Best candidates of a node that one order gives at first.
BEST = 3
#: Up to so many candidates (their ids take 16 MB) are sent to all tasks to pick texts; more are joined.
SENT = 2_000_000
#: Of TREES * DEPTH bits, those that two sketches may differ in. At a similarity of 0.8 they differ in 12.8 on average
#: with a deviation of 3.4, so 29 or more come once in 100,000 pairs, independently of the orders.
MOST_BITS = 28
#: The search between components is of few nodes and has a finer sketch, two bits of each of HASHES minhashes. At a similarity of 0.8
#: 38.4 of them differ on average with a deviation of 5.7, so 63 or more come once in 50,000 pairs.
HASHES, MOST_FINE = 256, 62
_CACHE = 200_000


class Shingler:
    """Sets of 64-bit shingle hashes of texts, and their minhashes."""

    def __init__(self, size: int):
        self.size, self.words = size, {}
        rng = np.random.Generator(np.random.PCG64(12))
        self.mul = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        self.weights = rng.integers(1, 1 << 63, max(size, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known, out = self.words, []
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) >= _CACHE:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes. With fewer words than a shingle has, the whole sequence is one; without words, none."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both work on ASCII alone
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        h = self._hashes(words)
        n = len(h) - self.size + 1
        x = np.zeros(n, np.uint64)
        for i in range(self.size):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] * self.weights[i]
            x ^= x >> np.uint64(29)
        return np.unique(x)

    def minhashes(self, s: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(s), 1024):
            h = (s[i : i + 1024, None] * self.mul + self.add) >> np.uint64(32)
            least = np.minimum(least, h.min(0).astype(np.uint32))
        return least


_SHINGLERS: dict[int, Shingler] = {}


def _shingler(size: int) -> Shingler:
    return _SHINGLERS.setdefault(size, Shingler(size))


def _drop() -> None:
    _SHINGLERS.clear()


#: A signature: of the first TREES * DEPTH minhashes 16 bits each, the trees' keys; then the sketch, two bits of each of HASHES minhashes.
KEYS, SKETCH = TREES * DEPTH * 2, HASHES // 4


def signature(m: np.ndarray) -> bytes:
    sketch = np.packbits(np.stack([m >> np.uint32(8) & np.uint32(1), m >> np.uint32(9) & np.uint32(1)], 1).astype(np.uint8).ravel())
    return (m[: TREES * DEPTH] & np.uint32(0xFFFF)).astype(">u2").tobytes() + sketch.tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig): hash of the set and signature; null where there are no shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(size)
        for batch in slices(batches):
            n, hashes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler.set_of(text)
                n.append(len(s))
                hashes.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(shingler.minhashes(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(freeing(sign, _drop), "doc_id long, n_shingles long, set_hash binary, sig binary")


def _unpacked(sigs) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures: the trees' keys (rows by TREES by 2 * DEPTH bytes) and the sketches (rows of 64-bit numbers)."""
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, KEYS + SKETCH)
    return raw[:, :KEYS].reshape(-1, TREES, 2 * DEPTH), np.ascontiguousarray(raw[:, KEYS:]).view(np.uint64)


def _heads(keys: np.ndarray) -> np.ndarray:
    """Tree and first LEAST values of each key in one number (rows by TREES): the regions of a node."""
    out = np.broadcast_to(np.arange(TREES, dtype=np.int64), keys.shape[:2])
    for i in range(2 * LEAST):
        out = out << 8 | keys[:, :, i]
    return out


PAIR = "a long, b long, differ int"


Frame = dict[str, np.ndarray]


def _columns(held: list[pa.RecordBatch]) -> Frame:
    whole = pa.Table.from_batches(held)
    return {name: whole.column(name).to_numpy() for name in whole.column_names}


def _frame(ids: np.ndarray, i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> pa.RecordBatch:
    a, b = ids[i], ids[j]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), differ.astype(np.int32))], names=["a", "b", "differ"])


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


_NONE = np.empty(0, np.int64)


def near_pairs(frame: Frame) -> pa.RecordBatch:
    """Of a stretch of a sorted order: near rows that share LEAST values and pass the sketch and the size bound, BEST of each row, the most alike first."""
    ids, n, region = frame["node"], frame["n_shingles"], frame["region"]
    low, high = frame["b0"].view(np.uint64), frame["b1"].view(np.uint64)
    found = []
    for step in range(1, min(WINDOW, len(ids) - 1) + 1):
        i = np.flatnonzero(region[:-step] == region[step:])
        if not len(i):
            break
        j = i + step
        differ = np.bitwise_count(low[i] ^ low[j]).astype(np.int32) + np.bitwise_count(high[i] ^ high[j])
        ok = (differ <= MOST_BITS) & _alike(n[i], n[j])
        found.append((i[ok], j[ok], differ[ok]))
    if not found:
        return _frame(ids, _NONE, _NONE, _NONE)
    i, j, differ = (np.concatenate(x) for x in zip(*found))
    rows, others, by = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([differ, differ])
    order = np.lexsort((ids[others], by, rows))
    rows, others, by = rows[order], others[order], by[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < BEST
    return _frame(ids, rows[best], others[best], by[best])


def _differ(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1).astype(np.int32)


def crossing_links(frame: Frame, text: Callable[[int], str | None], shingler: Shingler, percent: int) -> Iterator[pa.RecordBatch]:
    """Of whole blocks, sorted by block and side: the links between rows of side 0 and of side 1 that are of other components.

    Pairs pass the size bound and the finer sketch, then their full sets are compared, the most alike first; those whose
    components links of this stretch have joined meanwhile are spared. Pairs that share a region of an earlier tree are
    left to it: all pairs of a region are compared, so that one is compared there. text gives a row's text.
    """
    ids, n, comp = (frame[c] for c in ("node", "n_shingles", "comp"))
    fine = np.frombuffer(b"".join(frame["fine"]), np.uint64).reshape(len(ids), -1)
    heads = np.frombuffer(b"".join(frame["heads"]), np.int64).reshape(len(ids), TREES)
    trees = frame["region"] >> (16 * LEAST)
    side, start = frame["side"], _block_starts(frame)
    block = np.cumsum(start) - 1
    firsts = np.append(np.flatnonzero(start), len(ids))
    n_rows = np.bincount(block, side == 0, len(firsts) - 1).astype(np.int64)
    first, count = firsts[:-1] + n_rows, np.diff(firsts) - n_rows
    rows = np.flatnonzero(side == 0)
    counts = count[block[rows]]
    chunk = np.cumsum(counts) // PAIRS_AT_ONCE
    joined: dict[int, int] = {}
    known: dict[int, np.ndarray] = {}

    def root(c: int) -> int:
        while c in joined:
            joined[c] = joined.get(joined[c], joined[c])
            c = joined[c]
        return c

    def set_at(i: int) -> np.ndarray:
        if i not in known:
            known[i] = shingler.set_of(text(i))
        return known[i]

    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(chunk)) + 1):
        c = counts[at]
        i = np.repeat(rows[at], c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[block[rows[at]]], c)
        ok = (comp[i] != comp[j]) & _alike(n[i], n[j])
        i, j = i[ok], j[ok]
        by = _differ(fine[i, :3] ^ fine[j, :3])
        ok = by <= MOST_FINE
        i, j, by = i[ok], j[ok], by[ok]
        by = by + _differ(fine[i, 3:] ^ fine[j, 3:])
        ok = by <= MOST_FINE
        i, j, by = i[ok], j[ok], by[ok]
        ok = ~((heads[i] == heads[j]) & (np.arange(TREES) < trees[i, None])).any(1)
        i, j, by = i[ok], j[ok], by[ok]
        order = np.lexsort((j, i, by))
        found = []
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q and _linked(set_at(x), set_at(y), percent):
                joined[max(p, q)] = min(p, q)
                found.append((x, y))
        if found:
            x, y = np.array(found).T
            yield _frame(ids, x, y, np.zeros(len(x)))
        if len(at) and len(known) > 2 * BLOCK:
            known.clear()


_BLOCK = ["region", "row_block", "col_block"]


def _block_starts(frame: Frame) -> np.ndarray:
    """Whether each row is the first of its block."""
    start = np.zeros(len(frame["node"]), bool)
    start[:1] = True
    for c in _BLOCK:
        start[1:] |= frame[c][1:] != frame[c][:-1]
    return start


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """The sorted rows of a task in stretches of STRETCH rows or STRETCH_BYTES or more, and whether each is the last; what is sent back comes before the next."""
    held, new, size = [], 0, 0
    for batch in chain(slices(batches, min(STRETCH, 1024)), [None]):
        if batch is not None:
            held.append(batch)
            new += len(batch)
            size += batch.nbytes
        if held and (batch is None or new >= STRETCH or size >= STRETCH_BYTES):
            back = yield pa.Table.from_batches(held), batch is None
            held, new, size = back.to_batches() if back is not None else [], 0, 0


def _in_blocks(size: int, percent: int):
    """Runs crossing_links() over the sorted rows of a task in stretches of whole blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, back, shingler = _stretches(batches), None, _shingler(size)
        with suppress(StopIteration):
            while True:
                rows, last = stretches.send(back)
                numbers = rows.drop_columns(["text", "fine", "heads"])
                end = len(rows) if last else int(np.flatnonzero(_block_starts(_columns(numbers.to_batches())))[-1])
                if end:
                    texts = rows.column("text")
                    yield from crossing_links(_columns(rows.slice(0, end).drop_columns(["text"]).to_batches()), lambda i: texts[i].as_py(), shingler, percent)
                back = rows.slice(end)

    return search


def _neighbours(pairs, window: int):
    """Runs pairs() over the sorted rows of a task in stretches, with the last rows of each before the next."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, back = _stretches(batches), None
        with suppress(StopIteration):
            while True:
                rows, _ = stretches.send(back)
                yield pairs(_columns(rows.to_batches()))
                back = rows.slice(max(0, len(rows) - window))

    return search


def _orders(nodes: DataFrame) -> DataFrame:
    """(region, key, node, n_shingles, b0, b1) of nodes (node, n_shingles, sig): a row for each tree. The region begins with the tree."""
    schema = pa.schema([("region", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keys, fine = _unpacked(batch.column(2).to_pylist())
            bits = fine[:, : TREES * DEPTH // 32] & np.uint64(0x5555555555555555)  # one bit of each minhash of the keys
            bits = (bits[:, ::2] | bits[:, 1::2] << np.uint64(1)).view(np.int64)
            again = lambda x: pa.array(np.repeat(np.asarray(x), TREES))
            named = pa.array(keys.reshape(-1, 2 * DEPTH).copy().view(f"V{2 * DEPTH}").ravel().tolist(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_heads(keys).ravel()), named, *map(again, (batch.column(0), batch.column(1), bits[:, 0], bits[:, 1]))], schema=schema)

    return nodes.select("node", "n_shingles", "sig").mapInArrow(freeing(rows), "region long, key binary, node long, n_shingles long, b0 long, b1 long")


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a < b) of near nodes over all sorted orders."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = _orders(nodes).repartitionByRange(parts, "region", "key", "node").sortWithinPartitions("region", "key", "node")
    return order.mapInArrow(freeing(_neighbours(near_pairs, WINDOW)), PAIR).groupBy("a", "b").agg(F.min("differ").alias("differ"))


def _regions_of(sets: DataFrame) -> DataFrame:
    """(node, n_shingles, fine, heads) of (node, n_shingles, sig): the sketch, and the regions of all trees as 64-bit numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keys, fine = _unpacked(batch.column(2).to_pylist())
            told = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (fine, _heads(keys))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names=["node", "n_shingles", "fine", "heads"])

    return sets.select("node", "n_shingles", "sig").mapInArrow(freeing(rows), "node long, n_shingles long, fine binary, heads binary")


def in_regions(nodes: DataFrame) -> DataFrame:
    """(node, region, n_shingles), for each region that has more than one node."""
    rows = _orders(nodes).select("node", "region", "n_shingles")
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(shared, "region").select("node", "region", "n_shingles")


def mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, region, comp, largest, row_blocks, col_blocks) of in_regions() rows in regions with several components; parts: (id, component) of linked nodes.

    Of each region, all rows but those of its largest component are to meet all rows, in blocks of about BLOCK rows and
    BLOCK_SHINGLES shingles of each side at most.
    """
    rows = members.join(parts.withColumnRenamed("id", "node"), "node", "left").select("node", "region", "n_shingles", F.coalesce("component", "node").alias("comp"))
    counts = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    regions = counts.groupBy("region").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "s", "comp")).alias("top")).filter("comps > 1")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    regions = regions.select("region", F.col("top.comp").alias("largest"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("row_blocks"), blocks(F.col("n"), F.col("s")).alias("col_blocks"))
    return rows.join(regions, "region").drop("n_shingles")


def between(active: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a < b) of nodes of different components that share a region, enough to join all that are linked.

    active: mixed(); sketches: (node, n_shingles, fine, heads); texts: (doc_id, text). Rows of both sides are dealt to
    blocks by hashes of nodes and repeated for each block of the other side. Pairs are compared in the blocks, and
    only links leave them.
    """
    rows = active.join(sketches, "node").join(texts.withColumnRenamed("doc_id", "node"), "node")
    of = F.xxhash64("node")
    taken = ["node", "comp", "n_shingles", "fine", "heads", "region", "text"]
    sides = rows.withColumn("side", F.explode(F.when(F.col("comp") != F.col("largest"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    own_row, own_col = F.pmod(of, F.col("row_blocks")).cast("int"), F.pmod(of, F.col("col_blocks")).cast("int")
    dealt = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("col_blocks")).otherwise(F.col("row_blocks")) - 1)))
    dealt = dealt.select(*taken, "side", F.when(F.col("side") == 0, own_row).otherwise(F.col("other")).alias("row_block"), F.when(F.col("side") == 0, F.col("other")).otherwise(own_col).alias("col_block"))
    n = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = dealt.repartition(n, *_BLOCK).sortWithinPartitions(*_BLOCK, "side", "node")
    return order.mapInArrow(freeing(_in_blocks(size, percent), _drop), PAIR).select("a", "b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: (doc_id, text).

    Nodes are dealt to blocks by hash, and a pair belongs to the pair of its blocks: a text moves once for each of
    these that it is needed in, however many pairs a hub has there, and its set is made once.
    """
    sizes = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(LEAST_BLOCKS, -(-sizes["n"] // BLOCK), -(-sizes["bytes"] // BLOCK_BYTES))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.select("a", "b", F.least(of("a"), of("b")).alias("x"), F.greatest(of("a"), of("b")).alias("y"))
    ends = dealt.select("x", "y", "a").unionByName(dealt.select("x", "y", F.col("b").alias("a"))).distinct()
    told = ends.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("x", "y", F.lit(0).alias("tag"), "a", F.lit(None).cast("long").alias("b"), "text")
    asked = dealt.select("x", "y", F.lit(1).alias("tag"), "a", "b", F.lit(None).cast("string").alias("text"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = told.unionByName(asked).repartition(n, "x", "y").sortWithinPartitions("x", "y", "tag", "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, sets = _shingler(size), None, {}
        for batch in slices(batches):
            left, right = [], []
            for x, y, tag, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) != now:
                    now, sets = (x, y), {}
                if not tag:
                    sets.setdefault(a, []).append(shingler.set_of(text))
                    continue
                # an id that rows repeat with several texts is linked by any of them
                if any(_linked(s, t, percent) for s in sets.get(a, ()) for t in sets.get(b, ())):
                    left.append(a)
                    right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(freeing(check, _drop), "a long, b long").distinct()


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if len(s) > len(t):
        s, t = t, s
    if not len(s) or 100 * len(s) < percent * len(t):
        return False
    shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components; parts: (id, component) of linked nodes."""
    left = parts.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = parts.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    out = pairs.join(left, "a", "left").join(right, "b", "left")
    return out.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "differ")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id long, text).

    component_id is the smallest doc_id that links reach; kept marks it. Null and blank texts have no shingles and
    link with nothing. Texts are taken whole. Equal sets are found by hash, in groups of any size. Rows that repeat a
    doc_id count as one document with links of either; rows with a null doc_id join a component by an equal set only.
    An empty table gives an empty result; other columns are ignored. The size bound, the sketches' limits and LEAST are
    those of a similarity of 0.8, so a lower percent, which would lose links, is refused.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the percentage must be from 80 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with temporary(docs.sparkSession) as tables:
        signed = tables(signatures(docs, size), "signatures")
        first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n_shingles", "sig")))
        nodes = signed.filter("n_shingles > 0").groupBy("set_hash").agg(first.alias("f")).filter("f is not null")
        sets = tables(nodes.select("set_hash", F.col("f.doc_id").alias("node"), "f.n_shingles", "f.sig"), "sets")

        def picked(ids: DataFrame) -> DataFrame:
            return tables(docs.join(F.broadcast(ids) if ids.count() <= SENT else ids, "doc_id", "left_semi"), "texts")

        pairs = tables(candidates(sets), "pairs")
        # Texts are needed of candidates only: each is picked once, and all that follows moves these.
        texts = picked(tables(_ends(pairs), "ends"))
        to_best = pairs.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        parts = components(confirmed(to_best, texts, size, percent), "a", "b")

        def joined(found: DataFrame) -> DataFrame:
            """Components after more links."""
            return components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found.select("a", "b")), "a", "b")

        rest = _crossing(pairs.join(to_best, ["a", "b"], "left_anti"), parts)
        more = tables(confirmed(rest, texts, size, percent), "links")
        if more.head(1):
            parts = joined(more)
        # Every other pair of a region whose nodes are of different components by now.
        members = tables(in_regions(sets), "members")
        active = tables(mixed(members, parts), "mixed")
        nodes = tables(active.select(F.col("node").alias("doc_id")).distinct(), "mixed_nodes")
        tables.drop(members, pairs, texts)
        sketches = _regions_of(sets.join(nodes.withColumnRenamed("doc_id", "node"), "node", "left_semi"))
        found = tables(between(active, sketches, picked(nodes), size, percent), "links")
        if found.head(1):
            parts = joined(found)

        label = sets.select("set_hash", "node").join(parts.withColumnRenamed("id", "node"), "node", "left")
        label = label.select("set_hash", F.coalesce("component", "node").alias("c"))
        out = signed.select("doc_id", "n_shingles", "set_hash").join(label, "set_hash", "left")
        component = F.coalesce("c", "doc_id")
        return stored(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "near")


def op10_minhash_forest(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


QUERIES = {"op10_minhash_forest": op10_minhash_forest}

#: Brute force over all pairs that share a shingle, and a closure over their links.
ORACLE_SQL = {
    "op10_minhash_forest": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
}
