"""Graphs as edge DataFrames: connected components and greedy commits. No step gathers a graph on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.storage import Tables, stored, temporary


#: Edges that a task contracts at a time.
STRETCH = 1 << 19
#: Edges that a greedy commit leaves to one task: some ten megabytes.
SCANNED = 1 << 20


def _put(tables: Tables, e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The stored table, and its count and sum of row hashes (equal for equal sets of rows), taken as it is written."""
    seen = Observation()
    out = tables(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*e.columns).cast("decimal(38,0)")).alias("h")), name)
    got = seen.get
    return out, (got["n"], got["h"])


def joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u and v (numbers of nodes) in root, which has the smallest node of each node's tree."""
    while True:  # both ends take the smaller root, then roots are followed to their own
        a, b = root[u], root[v]
        if (a == b).all():
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _contracted(e: DataFrame) -> DataFrame:
    """Fewer edges (u > v) with the same components: each task turns its stretches of edges into stars around their smallest ids."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += len(batch)
            if size and (batch is None or size >= STRETCH):
                both = [np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in (0, 1)]
                kind, held, size = held[0].column(0).type, [], 0
                ids, ends = np.unique(np.concatenate(both), return_inverse=True)
                root = np.arange(len(ids))
                joined(root, ends[: len(both[0])], ends[len(both[0]) :])
                at = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], kind), pa.array(ids[root[at]], kind)], names=["u", "v"])

    return e.mapInArrow(stars, e.schema)


def _large_star(e: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node among the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; u > v in every edge."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(id, component) of each node of an edge: component is the smallest id that it is connected with.

    Tasks contract their own edges first. Then large-star and small-star steps alternate, which keep the edge count bounded and end in stars after about
    log(nodes) rounds. Each round is written to shared storage, so lineage stays short and lost executors do no harm.
    Null ends and loops are dropped; repeated edges do not matter; no edges give no rows. Ids may be of any type
    with an order.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    with temporary(edges.sparkSession) as tables:
        e, before = _put(tables, _contracted(e).distinct(), "edges")
        for _ in range(most_rounds):
            if not before[0]:
                break
            last = e
            e, now = _put(tables, _small_star(_large_star(e)), "edges")
            tables.drop(last)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        roots = e.select(F.col("v").alias("id")).distinct()
        return stored(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))), "components")


def _scanned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that drop out of the greedy scan, by one task that goes through the edges in order."""
    rows = edges.join(nodes.select(F.col("seq_id").alias("dst"), "ord"), "dst").select("ord", "src", "dst").coalesce(1).sortWithinPartitions("ord")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = set()
        for batch in batches:
            out.update(dst for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if src not in out)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), kind)], names=["id"])

    kind = to_arrow_type(edges.schema["dst"].dataType)
    return rows.select("src", "dst").mapInArrow(scan, T.StructType([T.StructField("id", edges.schema["dst"].dataType)]))


def greedy_commit(nodes: DataFrame, edges: DataFrame, scanned: int = SCANNED) -> DataFrame:
    """(seq_id, ord, is_rep) of nodes (seq_id, ord): a node is a representative unless one before it in order is its neighbour.

    edges: (src, dst), src before dst. That is the greedy scan, in rounds: nodes with no undecided neighbour before
    them become representatives, and their neighbours drop out. The first undecided node is always decided. Once
    ``scanned`` edges at most are left, a task goes through them in order.
    """
    with temporary(edges.sparkSession) as tables:
        live, seen = edges.select("src", "dst"), (edges.count(), None)
        if seen[0] > scanned:
            live, seen = _put(tables, live.distinct(), "edges")
        dropped = None
        while seen[0]:
            last = seen[0] <= scanned
            if last:
                out = _scanned(nodes, live)
            else:
                reps = live.select(F.col("src").alias("id")).distinct().join(live.select(F.col("dst").alias("id")), "id", "left_anti")
                out = tables(live.join(reps.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct(), "dropped")
            dropped = out if dropped is None else dropped.unionByName(out)
            if last:
                break
            left = live.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
            before = live
            live, seen = _put(tables, left.select("src", "dst"), "edges")
            tables.drop(before)
        if dropped is None:
            return nodes.select("seq_id", "ord", F.lit(True).alias("is_rep"))
        gone = stored(dropped.select(F.col("id").alias("seq_id"), F.lit(False).alias("is_rep")), "dropped")
    return nodes.select("seq_id", "ord").join(gone, "seq_id", "left").select("seq_id", "ord", F.coalesce("is_rep", F.lit(True)).alias("is_rep"))


def assigned(marked: DataFrame, edges: DataFrame, by: list) -> DataFrame:
    """(seq_id, root_id): representatives stand for themselves, others go to the representative that comes first ``by`` (columns of edges, or rep_ord)."""
    reps = marked.filter("is_rep").select(F.col("seq_id").alias("src"), F.col("ord").alias("rep_ord"))
    members = marked.filter("not is_rep").select(F.col("seq_id").alias("dst"))
    first = edges.join(reps, "src").join(members, "dst").groupBy("dst").agg(F.min(F.struct(*by, F.col("src"))).alias("b"))
    own = marked.filter("is_rep").select("seq_id", F.col("seq_id").alias("root_id"))
    return own.unionByName(first.select(F.col("dst").alias("seq_id"), F.col("b.src").alias("root_id")))
