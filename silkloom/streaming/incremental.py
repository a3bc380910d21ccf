"""Streams of sequences: against fixed representatives, and greedy clustering that finds its representatives as it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.candidates import between
from ..operators.cluster import greedy_clusters
from ..operators.index import WordIndex, build_index
from ..operators.kmers import ranked
from ..plans.storage import scratch, stored


def best_of(matches: DataFrame) -> DataFrame:
    """(seq_id, root_id, jaccard) of pairs (src, dst, jaccard): the most similar base sequence; ties to the smaller id."""
    best = F.min(F.struct((-F.col("jaccard")).alias("j"), "src"))
    return matches.groupBy(F.col("dst").alias("seq_id")).agg(best.alias("b")).select("seq_id", F.col("b.src").alias("root_id"), (-F.col("b.j")).alias("jaccard"))


def assign_batch(base: WordIndex, batch: DataFrame, tau: float) -> DataFrame:
    """(seq_id, root_id, jaccard) for each sequence of a batch; root_id is null for those that no representative is similar to."""
    return batch.select("seq_id").join(best_of(base.matches(batch, tau)), "seq_id", "left")


def assign_stream(stream: DataFrame, base: DataFrame | WordIndex, path: str, checkpoint: str, k: int = 5, tau: float = 0.9, **trigger) -> StreamingQuery:
    """Appends each micro-batch's assignments, with its number, to Parquet at path. A batch that is run again replaces its own part.

    base: the representatives (seq_id, seq), whose index is built once, or an index that is there already.
    """
    index = base if isinstance(base, WordIndex) else build_index(base, k, scratch(base.sparkSession, "index"))

    def write(batch: DataFrame, number: int) -> None:
        assign_batch(index, batch, tau).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def greedy_batch(reps: DataFrame | None, batch: DataFrame, k: int, tau: float) -> DataFrame:
    """(seq_id, root_id) of a batch: the first representative in the order longest first that a sequence is similar to, else what greedy clustering of the rest among themselves gives."""
    found = None
    if reps is not None:
        order = ranked(reps).select(F.col("seq_id").alias("src"), "ord")
        first = F.min(F.struct("ord", "src"))
        found = stored(between(reps, batch, k, tau).join(order, "src").groupBy(F.col("dst").alias("seq_id")).agg(first.alias("f")).select("seq_id", F.col("f.src").alias("root_id")), "found")
    rest = batch if found is None else batch.join(found, "seq_id", "left_anti")
    own = greedy_clusters(stored(rest.select("seq_id", "seq"), "rest"), k, tau)
    return own if found is None else own.unionByName(found)


def greedy_stream(stream: DataFrame, path: str, checkpoint: str, k: int = 5, tau: float = 0.5, **trigger) -> StreamingQuery:
    """Greedy clustering of a stream (seq_id, seq) of distinct ids: assignments (seq_id, root_id) under path/assigned, representatives (seq_id, seq) under path/representatives, by batch.

    A batch is held against the representatives of the batches before it, and those of its sequences that found none join
    them. A batch reads and writes by its number only, so one that is run again after a loss changes nothing. Batches in
    the order longest first give greedy_clusters() of the whole; in another order, an earlier sequence stands for a later one.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = stored(batch.select("seq_id", "seq"), "batch")
        before = [f"{path}/representatives/batch={n}" for n in range(number)]
        reps = spark.read.schema(batch.schema).parquet(*before) if before else None
        got = stored(greedy_batch(reps, batch, k, tau), "assigned")
        got.write.mode("overwrite").parquet(f"{path}/assigned/batch={number}")
        batch.join(got.filter("seq_id = root_id"), "seq_id", "left_semi").write.mode("overwrite").parquet(f"{path}/representatives/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
