"""Word multisets as sorted arrays, one row per sequence, and exact shared counts of candidate pairs.

A word is a whole number whose order is that of the alphabet, so counts, prefixes and intersections work on numbers.
Candidates meet their two multisets in blocks: sequences are dealt to blocks by hash, a pair belongs to the pair of its
blocks, and each sequence moves once for each pair of blocks that needs it, whatever its number of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of letters if none is given: that of the characters themselves.
LETTERS = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words and sequences of one block, on average; what a task holds follows from these, not from the table's size.
BLOCK_WORDS, BLOCK_ROWS, LEAST_BLOCKS = 1 << 22, 4096, 16
#: Words of one block where they are cut from letters: larger blocks move sequences less often.
CUT_WORDS = 1 << 23
#: Buckets of a multiset's profile, which bounds how much two multisets can share.
PROFILE = 4096

_SET = T.StructType([T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("distinct", T.LongType()), T.StructField("total", T.LongType())])


def _table(letters: str) -> np.ndarray:
    """Each byte's number: its place among the letters, and one number for all other characters."""
    out = np.full(256, len(letters), np.int64)
    out[np.frombuffer(letters.encode("latin-1"), np.uint8)] = np.arange(len(letters))
    return out


def letter_numbers(seq: str, letters: str) -> np.ndarray:
    """Each character's number: its place among the letters, or their number."""
    return _table(letters)[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def word_numbers(seq: str, k: int, letters: str = LETTERS, only: int | None = None) -> np.ndarray:
    """The words of a sequence in order of place; ``only``: of the first so many letters alone."""
    at = letter_numbers(seq, letters)
    n = len(at) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    out = reduce(lambda a, i: a * (len(letters) + 1) + at[i : i + n], range(k), np.zeros(n, np.int64))
    if only is None:
        return out
    bad = np.concatenate([[0], np.cumsum(at >= only)])
    return out[bad[k:] == bad[:-k]]


def word_sets(seqs: DataFrame, k: int, letters: str = LETTERS, only: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, len, total, distinct, codes, counts, columns to keep): sorted distinct words (int64) and counts (int32) of each sequence of at least k letters, as bytes.

    Characters outside ``letters`` count as one sign. ``total`` is the number of words that take part.
    """
    if (len(letters) + 1) ** k >= 1 << 63:
        raise ValueError("the word is too long for its alphabet")

    @F.pandas_udf(_SET)
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seq in batch:
                codes, counts = np.unique(word_numbers(seq, k, letters, only), return_counts=True)
                rows.append((codes.tobytes(), counts.astype(np.int32).tobytes(), len(codes), int(counts.sum())))
            yield pd.DataFrame(rows, columns=_SET.names)

    rows = seqs.filter(F.length("seq") >= k).select("seq_id", F.length("seq").cast("long").alias("len"), sets("seq").alias("s"), *keep)
    return rows.select("seq_id", "len", "s.total", "s.distinct", "s.codes", "s.counts", *keep)


def exploded(sets: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, code, cnt): one row per sequence and distinct word."""
    kind = T.StructType([*[sets.schema[c] for c in keep], T.StructField("code", T.LongType()), T.StructField("cnt", T.LongType())])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["distinct"].to_numpy()
            out = {c: batch[c].repeat(sizes).to_numpy() for c in keep}
            out["code"] = np.frombuffer(b"".join(batch["codes"]), np.int64)
            out["cnt"] = np.frombuffer(b"".join(batch["counts"]), np.int32).astype(np.int64)
            yield pd.DataFrame(out)

    return sets.select(*dict.fromkeys([*keep, "distinct", "codes", "counts"])).mapInPandas(rows, kind)


def word_text(code: Column, k: int, letters: str = LETTERS) -> Column:
    """The word of a number; other characters than letters show as ?."""
    base = len(letters) + 1

    def digit(i: int) -> Column:
        """(whole-number arithmetic but for an exact division)"""
        unit = base ** (k - 1 - i)
        return F.round((F.pmod(code, F.lit(unit * base)) - F.pmod(code, F.lit(unit))) / F.lit(unit)) if i else F.round((code - F.pmod(code, F.lit(unit))) / F.lit(unit))

    return F.concat(*[F.substring(F.lit(letters + "?"), digit(i).cast("int") + 1, F.lit(1)) for i in range(k)])


def number_of(word: Column, letters: str = LETTERS) -> Column:
    """The number of a word, as a column."""
    place = lambda c: F.call_function("locate", c, F.lit(letters))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * (len(letters) + 1) + F.when(place(c) > 0, place(c) - 1).otherwise(len(letters))))


def document_frequency(*sets: DataFrame) -> DataFrame:
    """(code, df): how many sequences of all the tables hold a word."""
    rows = [exploded(s).select("code") for s in sets]
    return reduce(DataFrame.unionByName, rows).groupBy("code").agg(F.count(F.lit(1)).alias("df"))


def rare_first(sets: DataFrame, df: DataFrame, *keep: str, others: bool = False) -> DataFrame:
    """exploded() with ``before``: the words of the sequence that are rarer than this one (fewer sequences, then the smaller number). others: words without a frequency stay, as the rarest; else they are left out."""
    order = Window.partitionBy("seq_id").orderBy("df", "code").rowsBetween(Window.unboundedPreceding, -1)
    rows = exploded(sets, *keep).join(df, "code", "left" if others else "inner").withColumn("df", F.coalesce("df", F.lit(0)))
    return rows.withColumn("before", F.coalesce(F.sum("cnt").over(order), F.lit(0))).drop("df")


class _Block:
    """The multisets of one side of a block by id and strand, with their profiles made as they are asked for."""

    def __init__(self, complement: tuple[int, int] | None):
        self.complement = complement
        self.sets: dict = {}
        self.profiles: dict = {}

    def add(self, ident, codes: bytes, counts: bytes) -> None:
        self.sets[ident, "+"] = np.frombuffer(codes, np.int64), np.frombuffer(counts, np.int32)

    def cut(self, ident, words: np.ndarray) -> None:
        """Adds the words of a sequence, in as few bytes as their numbers and counts ask for."""
        codes, counts = np.unique(words, return_counts=True)
        least = lambda x: x.astype(np.min_scalar_type(x.max(initial=0)))
        self.sets[ident, "+"] = least(codes), least(counts)

    def get(self, ident, strand: str = "+") -> tuple[np.ndarray, np.ndarray] | None:
        found = self.sets.get((ident, strand))
        if found is None and strand == "-" and (ident, "+") in self.sets:
            codes, counts = self.sets[ident, "+"]
            codes = complemented(codes, *self.complement)
            order = np.argsort(codes)
            found = self.sets[ident, strand] = codes[order], counts[order]
        return found

    def profile(self, ident, strand: str = "+") -> np.ndarray:
        at = ident, strand
        if at not in self.profiles:
            codes, counts = self.get(ident, strand)
            bucket = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            found = np.minimum(np.bincount(bucket.astype(np.int64), counts, PROFILE), 0xFFFF_FFFF).astype(np.uint32)
            self.profiles[at] = found.astype(np.min_scalar_type(found.max()))
        return self.profiles[at]


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """The size of the common multiset, and its distinct words."""
    (x, cx), (y, cy) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(x):
        return 0, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    return int(np.minimum(cx[hit], cy[at[hit]]).sum(dtype=np.int64)), x[hit]


def complemented(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """The numbers of the reverse complements of nucleotide words (A, C, G, T are 0 to 3)."""
    out, rest = np.zeros_like(codes), codes.copy()
    for _ in range(k):
        digit = rest % base
        out = out * base + np.where(digit < 4, 3 - digit, digit)
        rest //= base
    return out


def shared_counts(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None, complement: tuple[int, int] | None = None, checks: Callable | None = None, cut: int = 0, sizes: list | None = None) -> DataFrame:
    """(src, dst, strand, shared, first_code) of candidate pairs (src, dst, need) that share at least ``need`` words, counted with multiplicity.

    left and right are word_sets() tables; without right, both ids are of left. first_code is the smallest shared word.
    With ``complement`` (k, base), nucleotide words of dst are also taken as their reverse complements: strand is then -
    where these share enough, and first_code the smallest word of dst as it was given. A pair passes a bound by
    profiles before its arrays are compared. checks() makes a test for a pair of blocks: add(side, id, seq) of the
    column ``seq`` that both tables then have, and ok(src, dst, strand), which drops pairs. cut: the tables have (seq_id,
    seq) only, and words of so many letters are cut where a sequence meets others, as letters take less room than words; sizes
    then has the number of sequences in pairs (n) and of their words (w).
    """
    same = right is None
    tables = [left] if same else [left, right]
    sizes = sizes or [t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("w")).first() for t in tables]
    blocks, parts = sized(left.sparkSession, sizes, CUT_WORDS if cut else BLOCK_WORDS)
    kind = left.schema["seq_id"].dataType.simpleString()
    dealt = dealt_pairs(pairs.select("src", "dst", F.col("need").cast("long").alias("need")), left, right, blocks, [*([] if cut else ["codes", "counts"]), *(["seq"] if checks or cut else [])])
    rows = dealt.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "tag", "src")
    strands = "+-" if complement else "+"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, check = None, [], None
        for batch in batches:
            out = []
            none = [None] * len(batch)
            seqs = batch["seq"].tolist() if checks or cut else none
            sets = [none, none] if cut else [batch[c].tolist() for c in ("codes", "counts")]
            for x, y, tag, src, dst, need, codes, counts, seq in zip(*(batch[c].tolist() for c in ("x", "y", "tag", "src", "dst", "need")), *sets, seqs):
                if (x, y) != now:
                    now, held, check = (x, y), [_Block(complement), _Block(complement)], checks() if checks else None
                if tag < 2:
                    if cut:
                        held[tag].cut(src, word_numbers(seq, cut))
                    else:
                        held[tag].add(src, codes, counts)
                    if check:
                        check.add(tag, src, seq)
                    continue
                a, b = held[0], held[0 if same else 1]
                if a.get(src) is None or b.get(dst) is None:
                    continue
                for strand in strands:
                    if np.minimum(a.profile(src), b.profile(dst, strand)).sum(dtype=np.int64) < need:
                        continue
                    n, words = _shared(a.get(src), b.get(dst, strand))
                    if n >= max(need, 1) and (check is None or check.ok(src, dst, strand)):
                        out.append((src, dst, strand, n, int((complemented(words, *complement) if strand == "-" else words).min())))
            yield pd.DataFrame(out, columns=["src", "dst", "strand", "shared", "first_code"])

    return rows.mapInPandas(count, f"src {kind}, dst {kind}, strand string, shared long, first_code long")


def sized(spark: SparkSession, sizes: list, each: int) -> tuple[int, int]:
    """(blocks, partitions) for tables of n rows and w units of work: blocks of ``each`` units and BLOCK_ROWS rows on average, but LEAST_BLOCKS at least, unless there are only a few rows."""
    n = max(s["n"] for s in sizes)
    blocks = max(min(LEAST_BLOCKS, -(-n // 32)), 1, *[-(-s["n"] // BLOCK_ROWS) for s in sizes], *[-(-s["w"] // each) for s in sizes])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return blocks, min(parts, blocks * (blocks + 1) // 2)


def dealt_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame | None, blocks: int, payload: list[str]) -> DataFrame:
    """(x, y, tag, src, dst, columns of pairs, payload): rows dealt to pairs of blocks (x, y), where ids go to blocks by hash.

    tag 0 and 1 are rows of left and of right (id in src) with their payload, once for each pair of blocks that some pair
    needs them in, whatever the number of pairs; tag 2 are the pairs. Without right, both ids are of left.
    """
    same = right is None
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.withColumns({"x": of("src"), "y": of("dst")})
    if same:
        dealt = dealt.withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")})
    kinds, more = dict(pairs.dtypes) | {c: dict(left.dtypes)[c] for c in payload}, [c for c in pairs.columns if c not in ("src", "dst")]
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    asked = dealt.select("x", "y", F.lit(2).alias("tag"), "src", "dst", *more, *[null(c) for c in payload])

    def wanted(tag: int, rows: DataFrame, ids: DataFrame) -> DataFrame:
        found = ids.distinct().join(rows.select(F.col("seq_id").alias("src"), *payload), "src")
        return found.select("x", "y", F.lit(tag).alias("tag"), "src", null("dst"), *[null(c) for c in more], *payload)

    ends = dealt.select("x", "y", "src"), dealt.select("x", "y", F.col("dst").alias("src"))
    sides = wanted(0, left, ends[0].unionByName(ends[1])) if same else wanted(0, left, ends[0]).unionByName(wanted(1, right, ends[1]))
    return sides.unionByName(asked)
