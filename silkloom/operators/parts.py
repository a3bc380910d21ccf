"""Pairs of high similarity by equal parts of their words, without a join of words.

Two multisets of a and b words that reach a similarity of tau differ in (a + b) * (1 - tau) / (1 + tau) words at most. Dealt
by a hash into one part more than that, they have a part that is the same in both. A part holds several words (nine at
0.9), so hardly any but like sequences have one in common, and no pair that reaches tau is missing. The parts' signatures
travel packed, six bytes for each; sequences with the same text have one key, so copies meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordsets import LETTERS, word_numbers

#: Below this similarity parts would hold too few words to tell sequences apart.
LEAST_TAU = 0.85
#: Sequences and signatures that a task packs at a time, and signatures of a bucket on average.
PACKED_ROWS, PACKED, BUCKET = 16384, 2_000_000, 1_000_000
#: Pairs that a task lists at a time: many like texts have the square of their number of pairs.
LISTED = 1 << 20
#: Sizes of one class differ by this factor at most; it is above 1 / LEAST_TAU, so a size reaches into the next class only.
RATIO = 1.3

_STEP = log(RATIO)


def text_key(seq: Column) -> Column:
    """A sequence's key, the same for equal texts."""
    return F.conv(F.substring(F.md5(seq), 1, 15), 16, 10).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which spreads numbers over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def elements(codes: np.ndarray) -> np.ndarray:
    """Hashes of a multiset's elements: each word with the number of its occurrence, so that multisets differ as sets of elements do."""
    codes = np.sort(codes)
    at = np.arange(len(codes))
    first = np.concatenate([[True], codes[1:] != codes[:-1]])
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    with np.errstate(over="ignore"):
        return mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(nth.astype(np.uint64) + np.uint64(1)))


def classes(total: int, tau: float) -> list[tuple[int, int]]:
    """(class of sizes, its number of parts) for each class that holds sizes from total to total / tau."""
    out = []
    for c in range(floor(log(total) / _STEP - 1e-9), floor(log(total / tau) / _STEP + 1e-9) + 1):
        most = RATIO ** (c + 1) * (1 + 1e-6)
        out.append((c, floor(2 * most * (1 - tau) / (1 + tau) + 1e-4) + 1))
    return out


def signatures(codes: np.ndarray, tau: float) -> np.ndarray:
    """The signatures of all parts of a sequence, for each class of sizes that it may be paired in."""
    e, out = elements(codes), []
    low, high = (e & np.uint64(0x3FFFFFF)).astype(float), ((e >> np.uint64(26)) & np.uint64(0x3FFFFFF)).astype(float)
    of = e >> np.uint64(32)
    for c, parts in classes(len(e), tau):
        part = ((of * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        sums = [np.bincount(part, w, parts).astype(np.uint64) for w in (low, high)]  # whole numbers below 2^53: exact, in any order
        place = mixed(np.arange(parts, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(32)))
        out.append(mixed(sums[0] ^ mixed(sums[1] ^ place)))
    return np.concatenate(out)


def _packed(seqs: DataFrame, k: int, tau: float, buckets: int) -> DataFrame:
    """(bucket, keys, sigs, at): signatures by bucket, each with the place of its sequence in keys."""

    def pack(keys: list, sigs: list) -> pd.DataFrame:
        all_sigs = np.concatenate(sigs)
        at = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(s) for s in sigs])
        bucket = ((all_sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        low, rows = all_sigs.astype(np.uint32), []
        for b, (lo, hi) in enumerate(zip(ends, ends[1:])):
            if lo < hi:
                held, place = np.unique(at[order[lo:hi]], return_inverse=True)
                rows.append((b, np.array(keys, np.int64)[held].tobytes(), low[order[lo:hi]].tobytes(), place.astype(np.uint16).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "keys", "sigs", "at"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sigs, n = [], [], 0
        for batch in batches:
            for key, seq in zip(batch["key"].tolist(), batch["seq"].tolist()):
                keys.append(key)
                sigs.append(signatures(word_numbers(seq, k, LETTERS), tau))
                n += len(sigs[-1])
                if len(keys) >= PACKED_ROWS or n >= PACKED:
                    yield pack(keys, sigs)
                    keys, sigs, n = [], [], 0
        if keys:
            yield pack(keys, sigs)

    return seqs.filter(F.length("seq") >= k).select("key", "seq").mapInPandas(rows, "bucket int, keys binary, sigs binary, at binary")


def least_parts(a: Column, b: Column, tau: float) -> Column:
    """How many equal parts sequences of two sizes have if they reach tau (never too many): each word that only one of them holds spoils one part at most."""
    c = F.floor(F.log(F.greatest(a, b).cast("double")) / _STEP - 1e-9)
    parts = F.floor(F.pow(F.lit(RATIO), c + 1) * (1 + 1e-6) * (2 * (1 - tau) / (1 + tau)) + 1e-5) + 1
    return F.greatest(F.lit(1), parts - F.floor((a + b) * ((1 - tau) / (1 + tau)) + 1e-4)).cast("long")


def _summed(pairs: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, and the sums of their counts."""
    at = np.concatenate(pairs)
    order = np.lexsort((at[:, 1], at[:, 0]))
    at, n = at[order], np.concatenate(counts)[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1)]))
    return at[new], np.add.reduceat(n, new)


def _stretches(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of successive entries that make LISTED pairs at most, or of one entry that makes more."""
    upto, at = np.concatenate([[0], np.cumsum(count)]), 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + LISTED, "right")) - 1)
        yield at, end
        at = end


def _meetings(group: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of keys that have signatures of a bucket in common, and how many. A pair may come again if there are more than LISTED pairs."""
    held = [x for b in group for x in zip(b["keys"], b["sigs"], b["at"])]
    sigs = np.concatenate([np.frombuffer(x, np.uint32) for _, x, _ in held])
    keys = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(y, np.uint16)] for x, _, y in held])
    order = np.lexsort((keys, sigs))
    sigs, keys = sigs[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1])]))
    sigs, keys, times = sigs[new], keys[new], np.diff(np.append(new, len(sigs)))  # parts of one text may have one signature, as copies of it have
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    sizes = np.diff(np.append(starts, len(sigs)))
    after = np.arange(1, len(sigs) + 1)  # an entry meets those of its signature from here on
    count = np.repeat(starts + sizes, sizes) - after
    pairs, counts = np.empty((0, 2), np.int64), np.empty(0, np.int64)
    for lo, hi in _stretches(count):
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        if not len(i):
            continue
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c - after[lo:hi], c)
        pairs, counts = _summed([pairs, np.stack([keys[i], keys[j]], 1)], [counts, np.minimum(times[i], times[j])])
        if len(pairs) >= LISTED:
            yield pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1], "parts": counts})
            pairs, counts = pairs[:0], counts[:0]
    if len(pairs):
        yield pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1], "parts": counts})


def part_pairs(seqs: DataFrame, k: int, tau: float) -> DataFrame:
    """(x, y, parts): the keys of unlike texts of (key, len, seq), key being text_key(), that may reach a similarity of tau, each pair once, x below y, and how many equal parts they have at least. No pair that reaches tau is missing, or has fewer parts than least_parts()."""
    if tau < LEAST_TAU:
        raise ValueError(f"parts tell sequences apart from a similarity of {LEAST_TAU} on")
    letters = seqs.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, ceil(letters * 2 * (1 - tau) * 1.6 / (1 + tau) / BUCKET))
    parts = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def listed(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _meetings(list(group))

    rows = _packed(seqs, k, tau, buckets)
    met = rows.repartition(min(parts, buckets), "bucket").groupBy("bucket").applyInPandas(listed, "x long, y long, parts long")
    return met.groupBy("x", "y").agg(F.sum("parts").alias("parts"))
