"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source has a target in words. A document's expected copies are target / source size; their prefix sum runs over
the source in a seeded order (by size class, largest first, then at random), one random offset is added, and the
document is emitted once for each integer boundary that its stretch crosses.

The prefix sum does not put a source into one task. Rows are dealt to buckets by (source, size class, leading bits of a
seeded key); a small table of bucket counts gives each bucket's start, and only the rank inside a bucket needs a window.
So a source with a third of all rows spreads over as many tasks as any other rows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, leading_bits, seeded_key, table, with_word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to (skey, source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. Together they share the sum of all sizes; no
    target exceeds max_repeat times its source, and what is over goes to the others by weight. Sorted by cap / weight,
    a source is capped exactly if its share of what the sources before it leave exceeds its cap, so two running sums
    replace the rounds. The table has one row per source, so its windows are small.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.pmod(turn, F.lit(len(weights))) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeat).withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest_w", F.sum("w").over(rest))
    s = s.withColumn("capped", F.col("left") * F.col("w") > F.col("cap") * F.col("rest_w"))
    s = s.withColumn("r", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
    s = s.withColumn("free_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole))
    share = (F.col("r") * F.col("w")).cast("double") / F.col("free_w").cast("double")
    return s.select("skey", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes for each power of two; 0 for size 0. Whole-number arithmetic, so any engine agrees."""
    bits = F.length(F.bin(size))
    return F.when(size == 0, F.lit(0)).otherwise(bits * 8 + F.call_function("shiftright", size * 8, bits - 1) - 8).cast("int")


def mix(
    docs: DataFrame,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = SEED,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """One row per row of docs: ``row`` (struct of the carried columns; all, by default), size, source_size, target, copies.

    Null texts and texts without words have size 0 and take nothing. A null source is a source of its own. Repeated
    rows count each. Rows alike in id and text are interchangeable, so ties do not change the result. An empty table
    gives an empty result. Columns of docs cannot clash, as they stay inside ``row``.
    """
    nb = buckets_for(docs.count(), bucket_rows)
    key = seeded_key(seed, F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_llm_text"), key.alias("h"),
    )
    rows = with_word_count(rows, "_llm_text", "size").drop("_llm_text")
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = rows.withColumn("cls", size_class(F.col("size"))).withColumn("bucket", F.floor(leading_bits(F.col("h")) * nb / (1 << 32)).cast("long"))

    counts = rows.groupBy("skey", "cls", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.max("source").alias("source"))
    goal = targets(counts.groupBy("skey").agg(F.max("source").alias("source"), F.sum("words").alias("source_size")), weights, max_repeat)
    class_start = counts.groupBy("skey", "cls").agg(F.sum("n").alias("n"))
    to_here = Window.partitionBy("skey").orderBy(F.desc("cls")).rowsBetween(Window.unboundedPreceding, -1)
    class_start = class_start.select("skey", "cls", F.coalesce(F.sum("n").over(to_here), F.lit(0)).alias("class_start"))
    to_here = Window.partitionBy("skey", "cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("skey", "cls", "bucket", F.coalesce(F.sum("n").over(to_here), F.lit(0)).alias("bucket_start"))
    starts = starts.join(class_start, ["skey", "cls"]).join(goal, "skey")
    starts = starts.select("skey", "cls", "bucket", (F.col("class_start") + F.col("bucket_start")).alias("start"), "source_size", "target")

    rank = F.row_number().over(Window.partitionBy("skey", "cls", "bucket").orderBy("h", "size"))
    placed = rows.drop("source").join(starts, ["skey", "cls", "bucket"]).withColumn("p", F.col("start") + rank)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    offset = leading_bits(F.md5(F.concat(F.lit(f"{seed}:"), F.col("skey")))) / F.lit(float(1 << 32))
    placed = placed.withColumn("rate", rate).withColumn("u", offset)
    crossed = F.floor(F.col("rate") * F.col("p") + F.col("u")) - F.floor(F.col("rate") * (F.col("p") - 1) + F.col("u"))
    return placed.select("row", "size", "source_size", "target", F.least(F.lit(max_repeat), crossed).cast("int").alias("copies"))


def emitted(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each row of docs as often as the sampling takes it, with docs' columns."""
    taken = mix(docs, **kw).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


QUERIES = {"op2_mix_sources": op2_mix_sources}

ORACLE_SQL = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h
  FROM documents),
s0 AS (SELECT skey, max(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w, 3 * source_size AS cap,
              CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, total - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS remaining,
              CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w FROM s1),
s3 AS (SELECT *, remaining * w > cap * rest_w AS capped FROM s2),
s4 AS (SELECT *, total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS r, CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS free_w FROM s3),
s AS (SELECT skey, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(r * w AS DOUBLE) / CAST(free_w AS DOUBLE) END AS target,
             CAST(CAST('0x' || substr(md5('20:' || skey), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM s4),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)::INT) - 8 END AS cls FROM d),
p AS (SELECT c.*, row_number() OVER (PARTITION BY skey ORDER BY cls DESC, h, size) AS p FROM c),
q AS (SELECT doc_id, size, source_size, target, u, p, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM p JOIN s USING (skey)),
t AS (SELECT *, least(3, CAST(floor(rate * p + u) - floor(rate * (p - 1) + u) AS INT)) AS copies FROM q)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INT) AS copies FROM t
"""
}
