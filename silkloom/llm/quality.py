"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: a vectorised UDF measures the text, and column expressions set one failure
bit per rule. The ledger (measurements and ``failed`` bits) is what is stored; a policy is only a mask of the bits that
reject, so new policies, comparisons of versions and ablations are bitwise operations on the ledger and never touch the
texts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, stored, table, task

#: Fixed values of the contract.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")

#: (name, failing predicate), in the order of their bits. A bit never changes its meaning; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", f"n_words < {MIN_WORDS}"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "10 * n_upper_words > 4 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return reduce(int.__or__, (BIT[n] for n in names), 0)


BASE = mask("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {"v1": BASE | mask("symbols", "duplicate_lines"), "v2": mask(*BIT)}
CURRENT = "v2"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words whose sequence occurs at least twice, the first occurrence included.

    Doubling gives each window an exact number: words are numbered, then pairs of neighbours, pairs of pairs, and
    pairs of those.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    step = 1
    while step < WINDOW:
        _, ids = np.unique(ids[:-step] * np.int64(n + 1) + ids[step:], return_inverse=True)
        step *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


_SPACES = re.compile("[\x20\x09-\x0d]")


def measured(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text; all zero for null or no words. bytes.split() cuts at exactly the white space of a word's definition."""
    if not text:
        return (0,) * 7
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (
        len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), sum(map(bytes.isupper, words)),
    )


_MEASURED = pa.struct([(name, pa.int64()) for name in MEASURES])


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    with task():
        yield from by_slices(texts, lambda part: [dict(zip(MEASURES, measured(t))) for t in part], _MEASURED)


def failure_bits(m: str) -> Column:
    """The bits of the failed rules, from the struct column m of measurements."""
    fails = [F.when(F.expr(re.sub(r"\b(n_\w+|word_chars)", rf"{m}.\1", rule)), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    return reduce(lambda a, b: a.bitwiseOR(b), fails).cast("long")


def ledger(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: ``row`` (struct of the carried columns; all, by default), ``m`` (struct of measurements), ``failed`` (bits).

    Null, empty and blank texts measure 0 and fail few_words. Texts of any length are measured whole. Repeated rows
    give repeated rows, an empty table none; columns of docs cannot clash, as they stay inside ``row``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), measure(F.col(text_col)).alias("m"))
    return rows.withColumn("failed", failure_bits("m"))


def rejected(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with docs' columns."""
    return ledger(docs, text_col).filter(~rejected(policy)).select("row.*")


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, are rejected by it alone, and would be kept without it.

    The ledger is first counted by its bits (at most 2 to the number of rules rows), so the texts' number does not matter.
    """
    by_bits = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in BIT if BIT[n] & POLICIES[policy]]
    each = by_bits.select("n", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])).alias("hit"), F.explode(F.array(*rules)).alias("r"))
    fails = F.col("hit").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("hit") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when((F.col("hit") == 0) | alone, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def book_of(docs: DataFrame) -> DataFrame:
    """The stored ledger of documents: doc_id in ``row``, measurements and failure bits. Policies and ablations read it and no texts."""
    return stored(ledger(docs.select("doc_id", "text"), carry=["doc_id"]), "ledger")


def op3_quality_ledger(spark, sf_dir):
    book = book_of(table(spark, sf_dir, "documents"))
    return book.select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), (~rejected(CURRENT)).alias("kept"), "failed", *[(~rejected(p)).alias(f"kept_{p}") for p in POLICIES],
    )


def quality_ablations(spark, sf_dir):
    return ablations(book_of(table(spark, sf_dir, "documents")))


QUERIES = {"op3_quality_ledger": op3_quality_ledger, "quality_ablations": quality_ablations}

_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT id, i, word, lead(i, 7) OVER o IS NOT NULL AS whole,
             concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS eight
      FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
t AS (SELECT id, i, word, whole AND count(*) OVER (PARTITION BY id, eight, whole) > 1 AS twice FROM g),
r AS (SELECT id, word, max(twice) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS repeated FROM t),
a AS (SELECT id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (repeated) AS n_repeat_words,
             count(*) FILTER (regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS n_upper_words FROM r GROUP BY id),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_upper_words, 0) AS n_upper_words
      FROM d LEFT JOIN a USING (id) LEFT JOIN b USING (id)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
             + 16 * (10 * n_upper_words > 4 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 15 * n_words)::INT AS BIGINT) AS failed FROM m)
"""

ORACLE_SQL = {
    "op3_quality_ledger": _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, failed & 15 = 0 AS kept_v1, failed = 0 AS kept_v2 FROM f",
    "quality_ablations": _LEDGER + """
SELECT rule, CAST(count(*) FILTER (failed & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER (failed = bit) AS BIGINT) AS rejected_alone,
       CAST(count(*) FILTER (failed = 0 OR failed = bit) AS BIGINT) AS kept_without
FROM f, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('shouting', 16), ('short_words', 32), ('long_words', 64)) v(rule, bit)
GROUP BY rule
""",
}
