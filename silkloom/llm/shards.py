"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key within their source; the row of rank r (from 1) among n gets the fraction
(2r - 1) / 2n. In the order of these fractions every source is spread evenly, so equal cuts of that order have the
mixture of the whole. Counts of shards differ by one at most (law ``rows``).

Both ranks are found without a global sort in one task: rows are dealt to buckets (by leading bits of the key, then by
the fraction), a small table of bucket counts gives each bucket's start, and a window ranks rows inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, leading_bits, seeded_key, table

SEED = 7


def _starts(rows: DataFrame, within: list[str], bucket: str, out: str) -> DataFrame:
    """For each bucket (inside each value of the columns ``within``) the number of rows in the buckets before it."""
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    of_all = F.sum("n").over(Window.partitionBy(*within))
    return counts.select(*within, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(out), of_all.alias(f"{out}_of"))


def interleave(
    docs: DataFrame,
    shards: int = 16,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """One row per row of docs: ``row`` (struct of the carried columns; all, by default), shard (int) and slot (long, gapless from 0).

    A null source is a source of its own; null ids and texts are allowed. Rows alike in id and text are
    interchangeable, so repeated rows and ties give one result. Fewer rows than shards leave shards empty; an empty
    table gives an empty result. Columns of docs cannot clash, as they stay inside ``row``.
    """
    total = docs.count()
    nb = buckets_for(total, bucket_rows)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("skey"),
        seeded_key(seed, F.col(id_col), F.col(text_col)).alias("h"),
    )
    rows = rows.withColumn("b", F.floor(leading_bits(F.col("h")) * nb / (1 << 32)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("skey", "b").orderBy("h"))
    ranked = rows.join(_starts(rows, ["skey"], "b", "start"), ["skey", "b"]).withColumn("rank", F.col("start") + rank)
    ranked = ranked.withColumn("f", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("start_of")).cast("double")).drop("start", "start_of", "b")

    ranked = ranked.withColumn("g", F.floor(F.col("f") * nb).cast("long")).withColumn("one", F.lit(1))
    place = F.row_number().over(Window.partitionBy("one", "g").orderBy("f", "skey", "rank"))
    placed = ranked.join(_starts(ranked, ["one"], "g", "start"), ["one", "g"]).withColumn("p", F.col("start") + place - 1)
    placed = placed.withColumn("shard", F.expr(f"p * {shards} div {max(1, total)}"))
    return placed.select("row", F.col("shard").cast("int").alias("shard"), (F.col("p") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def op7_interleaved_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    docs = docs.select("doc_id", "text", "source", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = interleave(docs, 16, carry=["doc_id", "size", "text_crc32"])
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_interleaved_shards": op7_interleaved_shards}

ORACLE_SQL = {
    "op7_interleaved_shards": r"""
WITH bits(i, v) AS (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits),
d AS (SELECT doc_id, coalesce('s' || source, 't') AS skey, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes,
             md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h
      FROM documents),
e AS (SELECT doc_id, skey, size, h, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY h) AS rank, count(*) OVER (PARTITION BY skey) AS n, count(*) OVER () AS total FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n)::DOUBLE, skey, rank) - 1 AS p FROM r),
s AS (SELECT *, p * 16 // total AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
       CAST(p - (shard * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM s
"""
}
