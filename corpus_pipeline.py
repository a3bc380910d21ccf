"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run() writes each stage's
result as Parquet to the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkloom.llm import bpe, linededup, mix, neardup, quality
from silkloom.plans.storage import stored, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps. Null and blank texts fail it; repeated rows stay; an empty table stays empty; no column is touched."""
    return quality.apply_policy(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of line runs; those that lose their last words go. Null texts and ids are allowed (a null id comes first); rows alike in id and text keep the same lines."""
    return linededup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (word shingles of five, similarity 0.8): that with the smallest doc_id.

    A null doc_id stands for itself. Rows that repeat a kept doc_id and its text stay as one.
    """
    kept = neardup.near_duplicates(docs, size=5, percent=80).filter(F.col("doc_id").isNotNull() & F.col("kept")).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the sources' target weights takes it. A null source is a source; texts without words are not taken; an empty table stays empty."""
    return mix.emitted(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text decoded from them, for each row. A null text is an empty one; null and repeated ids stay as they are."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL cannot express the BPE stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark) as tables:
        for name, stage in STAGES[:-1]:
            last, docs = docs, tables(stage(spark, docs, sf_dir), name)
            tables.drop(last)
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), name)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
