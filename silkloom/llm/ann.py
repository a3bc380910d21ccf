"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is made nearest neighbour first: vectors are divided by the largest norm R and get one more
coordinate that fills them up to length 1; queries have length 1 and 0 there. Each of TABLES tables hashes with HASHES
Gaussian projections cut into slots of WIDTH. A query visits buckets in the order of their estimated success: a
neighbour of similarity s projects, given the query's projection u, to a normal variable with mean s*u and variance
1 - s*s, so a bucket's chance is the product of its slots' chances. Buckets are visited until the chances add up to
CHANCE in each table. s is fitted on a bounded sample of queries (SAMPLE), whose exact neighbours among all vectors are
found in one pass; everything else covers all vectors.

Vectors are dealt by table and shard (a hash of the bucket); buckets with more than a fixed share of all vectors are
split, so no task holds a hot bucket. In a task the vectors of a shard are the block that its queries, sorted behind
them, stream past. Scores are exact inner products in double precision of the original vectors. Queries that find too
few vectors search all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

TABLES, HASHES, WIDTH = 2, 8, 2.2
CHANCE, SAMPLE, NEAREST = 0.78, 64, 20
#: Vectors of a shard, about, and the share of all vectors from which on a bucket is split: at most this many buckets can be.
SHARD, HOT = 1 << 16, 10_000
#: Products of a block with queries that are held at once.
DENSE = 1 << 22
_ROW = "tab int, shard int, tag int, bucket long, id long, vec binary, probes binary"


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.array([math.erf(v) for v in (x / math.sqrt(2)).ravel()]).reshape(x.shape))


class Hashing:
    """The tables' projections, and the buckets of vectors and queries."""

    def __init__(self, dim: int, radius: float, similarity: float, kind: str, seed: int = 6):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.radius, self.kind = radius, kind
        self.s = min(max(similarity, 0.0), 1.0)
        self.spread = math.sqrt(max(1 - self.s**2, 1e-4))
        self.project = rng.standard_normal((TABLES, dim + 1, HASHES))
        self.shift = rng.random((TABLES, HASHES)) * WIDTH
        self.mix = rng.integers(1, 1 << 62, HASHES, dtype=np.int64) * 2 + 1

    def vectors(self, raw) -> np.ndarray:
        return np.stack([np.frombuffer(v, self.kind) for v in raw]).astype(np.float64)

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        x = x / self.radius
        x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])
        return (np.floor((x @ self.project[t] + self.shift[t]) / WIDTH).astype(np.int64) * self.mix).sum(1)

    def probes(self, q: np.ndarray, t: int) -> np.ndarray:
        """Buckets to visit, the likeliest first, until their chances add up to CHANCE."""
        u = np.append(q / np.linalg.norm(q), 0.0) @ self.project[t]
        mean = self.s * u
        first = np.floor((mean - 4 * self.spread + self.shift[t]) / WIDTH).astype(np.int64)
        slots = first[:, None] + np.arange(int(8 * self.spread / WIDTH) + 2)
        edges = np.concatenate([slots, slots[:, -1:] + 1], 1) * WIDTH - self.shift[t][:, None]
        chance = np.diff(_phi((edges - mean[:, None]) / self.spread), axis=1)
        best = np.append(np.cumprod(chance.max(1)[::-1])[::-1], 1.0)  # the most that the slots from k on can give
        floor = best[0] / 16
        while True:  # buckets from a chance on; that is lowered until they suffice
            floor /= 8
            p, code = np.ones(1), np.zeros(1, np.int64)
            for k in range(HASHES):
                more = p[:, None] * chance[k]
                at, slot = np.nonzero(more * best[k + 1] >= floor)
                p, code = more[at, slot], code[at] + slots[k][slot] * self.mix[k]
            if p.sum() >= CHANCE or floor < 1e-12:
                break
        order = np.argsort(-p, kind="stable")
        return code[order[: int(np.searchsorted(np.cumsum(p[order]), CHANCE)) + 1]]


def usable(df: DataFrame, vec: str) -> DataFrame:
    """(id, vec): the rows that take part. Null ids, and vectors that are null, empty, zero, hold nulls or non-finite
    components, or have another length than most do not."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    df = df.filter(F.col("id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)).filter(fine).withColumnRenamed(vec, "vec")
    most = df.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return df.filter(F.size("vec") == most["n"]) if most else df


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score and then id."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))


def _nearest(x: np.ndarray, ids: np.ndarray, rough: np.ndarray, q: np.ndarray, own: int, k: int):
    """The k best (ids, scores) of rows x for a query. Fast products (rough) choose, sums in one fixed order decide, so equal vectors tie."""
    rough[ids == own] = -np.inf
    take = k
    while True:
        cut = np.partition(rough, len(rough) - take)[len(rough) - take] if len(rough) > take else -np.inf
        at = np.flatnonzero(rough >= cut - 1e-9 * max(1.0, abs(cut))) if cut > -np.inf else np.flatnonzero(rough > -np.inf)
        score = (x[at] * q).sum(1)
        order = _top(ids[at], score, take)
        best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
        if len(best) >= k or cut == -np.inf:
            return ids[at][best[:k]], score[best[:k]]
        take *= 2  # some of these rows repeat an id


def similarity(vectors: DataFrame, queries: DataFrame, radius: float, kind: str, k: int) -> float:
    """A low quantile of the sample queries' similarity to their k-th neighbour, exact over all vectors."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    qs, own = [np.array(r["vec"], np.float64) for r in sample], [r["id"] for r in sample]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, ids = np.stack(b["vec"].to_numpy()).astype(np.float64), b["id"].to_numpy()
            for q, o in zip(qs, own):
                got, score = _nearest(x, ids, x @ q, q, o, k)
                yield pd.DataFrame({"q": o, "score": score / (np.linalg.norm(q) * radius)})

    order = Window.partitionBy("q").orderBy(F.desc("score"))
    worst = vectors.mapInPandas(best, "q long, score double").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("q").agg(F.min("score").alias("s"))
    found = sorted(r["s"] for r in worst.collect())
    return found[len(found) // 10] if found else 0.0


def search(df: DataFrame, queries, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row its k nearest other rows by inner product; ties to the smaller id.

    queries: a condition on the id column. Rows that repeat an id count as one candidate, with its best score. An
    empty table, or one without usable queries, gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    kind = "f4" if dict(df.dtypes)[vec_col] == "array<float>" else "f8"
    every = usable(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "f4" else "array<double>").alias("v")), "v")
    asked = every.filter(queries(F.col("id")))
    sizes = every.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("r2"), F.max(F.size("vec")).alias("dim")).first()
    n, radius = sizes["n"], math.sqrt(sizes["r2"] or 1.0) * (1 + 1e-12)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return none
    hashing = Hashing(sizes["dim"], radius, similarity(every, asked, radius, kind, k), kind)
    shards = max(12, n // SHARD)

    def index(hot: dict[tuple[int, int], tuple[int, int]]):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x, ids = np.stack(b["vec"].to_numpy()), b["id"].to_numpy()
                raw = [v.astype(kind).tobytes() for v in x]
                for t in range(TABLES):
                    buckets = hashing.buckets(x.astype(np.float64), t)
                    shard = (buckets % shards).astype(np.int32)
                    for i in [i for i, c in enumerate(buckets.tolist()) if (t, c) in hot] if hot else ():
                        at, parts = hot[t, int(buckets[i])]
                        shard[i] = shards + at + int(ids[i]) % parts
                    yield pd.DataFrame({"tab": np.int32(t), "shard": shard, "tag": np.int32(0), "bucket": buckets, "id": ids, "vec": raw, "probes": b""})

        return every.mapInPandas(rows, _ROW)

    counts = index({}).groupBy("tab", "bucket").count().filter(F.col("count") > max(SHARD, n // HOT)).collect()  # at most HOT * TABLES rows
    hot, at = {}, 0
    for r in sorted(counts, key=lambda r: (r["tab"], r["bucket"])):
        parts = -(-r["count"] // max(SHARD, n // HOT))
        hot[r["tab"], r["bucket"]] = at, parts
        at += parts
    last = at

    def asking(exhaustive: bool):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for ident, v in zip(b["id"].tolist(), b["vec"]):
                    raw = np.asarray(v, kind).tobytes()
                    for t in range(1 if exhaustive else TABLES):
                        if exhaustive:
                            out += [(t, s, 1, 0, ident, raw, b"") for s in range(shards + last)]
                            continue
                        by: dict[int, list[int]] = {}
                        for c in hashing.probes(np.asarray(v, np.float64), t).tolist():
                            first, parts = hot.get((t, c), (c % shards - shards, 1))
                            for part in range(parts):
                                by.setdefault(shards + first + part, []).append(c)
                        out += [(t, s, 1, 0, ident, raw, np.array(c, np.int64).tobytes()) for s, c in by.items()]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")]).astype({"tab": "int32", "shard": "int32", "tag": "int32", "bucket": "int64", "id": "int64"})

        return rows

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, now, ready = [], None, None
        for batch in batches:
            for key, rows in batch.groupby(["tab", "shard"], sort=False):
                if key != now:
                    block, now, ready = [], key, None
                own = rows[rows["tag"] == 0]
                if len(own):
                    block.append((hashing.vectors(own["vec"]), own["id"].to_numpy(), own["bucket"].to_numpy()))
                asks = rows[rows["tag"] == 1]
                if not len(asks) or not block:
                    continue
                if ready is None:
                    x, ids, buckets = (np.concatenate(p) for p in zip(*block))
                    names, size = np.unique(buckets, return_counts=True)
                    ready, block = (x, ids, names, size), [0]  # the rows come sorted by bucket
                step = max(1, DENSE // len(ready[1]))
                for i in range(0, len(asks), step):
                    yield answers(asks.iloc[i : i + step], *ready)

    def answers(asks: pd.DataFrame, x: np.ndarray, ids: np.ndarray, names: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        """The best rows of a block for some queries. Those that visit much of it share one matrix product; for the others the rows visited are picked."""
        q, own = hashing.vectors(asks["vec"]), asks["id"].to_numpy()
        seen = np.ones((len(q), len(names)), bool)
        for row, probes in zip(seen, asks["probes"]):
            if probes:
                wanted = np.frombuffer(probes, np.int64)
                at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                row[:] = False
                row[at[names[at] == wanted]] = True
        much = seen @ size > len(x) / 16
        products = iter(q[much] @ x.T)
        got = []
        for i, dense in enumerate(much.tolist()):
            rows = np.repeat(seen[i], size)
            if dense:
                rough = next(products)
                rough[~rows] = -np.inf
                got.append(_nearest(x, ids, rough, q[i], own[i], k))
            else:
                part = x[rows]
                got.append(_nearest(part, ids[rows], part @ q[i], q[i], own[i], k))
        return pd.DataFrame({"query_id": np.repeat(own, [len(g) for g, _ in got]), "vec_id": np.concatenate([g for g, _ in got]), "score": np.concatenate([s for _, s in got])})

    rows = index(hot)

    def found(q: DataFrame, exhaustive: bool) -> DataFrame:
        dealt = rows.filter("tab = 0" if exhaustive else "true").unionByName(q.mapInPandas(asking(exhaustive), _ROW))
        dealt = dealt.repartition("tab", "shard").sortWithinPartitions("tab", "shard", "tag", "bucket")
        merged = dealt.mapInPandas(visit, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stored(found(asked, False), "nearest")
    full = first.groupBy("query_id").count().filter(F.col("count") >= min(k, sizes["ids"] - 1)).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    if not short.head(1):
        return first
    again = stored(found(short, True), "nearest")
    return first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def op6_multiprobe_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


QUERIES = {"op6_multiprobe_ann": op6_multiprobe_ann}
