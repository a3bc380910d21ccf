"""Observed word shares: how many words pairs of an identity have in common, measured on the data at hand.

The strict bound on shared words assumes that differences lie as badly as they can. In data they do not: most pairs of
an identity share more, and a search that asks for as much as all but a few of them share has fewer candidates. The
table comes from a bounded sample of sequences, each changed at random to every identity from 40 to 100 percent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wordsets import letter_numbers

#: Identities in percent, word lengths in the order of the table, and the share of pairs that a tolerance from 1 on keeps.
PERCENTS, SIZES, COVERS = range(40, 101), (5, 4, 3, 2), (0.99, 0.95, 0.9, 0.8, 0.6)
#: Sequences of the sample, and letters that one has at least.
SAMPLE, SHORTEST = 500, 50


def changed(letters: np.ndarray, percent: int, kinds: int, rng: np.random.Generator) -> np.ndarray:
    """A copy in which all but so many percent of the letters (rounded down) are other ones."""
    out = letters.copy()
    at = rng.choice(len(out), len(out) - len(out) * percent // 100, replace=False)
    out[at] = (out[at] + rng.integers(1, kinds, len(at))) % kinds
    return out


def shared_words(a: np.ndarray, b: np.ndarray, size: int) -> int:
    """The words of a size that two sequences share, counted with multiplicity."""
    base = np.int64(32)
    numbers = [sum(x[i : len(x) - size + 1 + i].astype(np.int64) * base**i for i in range(size)) for x in (a, b)]
    (p, m), (q, n) = (np.unique(x, return_counts=True) for x in numbers)
    _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def observed_shares(seqs: DataFrame, letters: str, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """(tolerance, identity, size, share): the percentage of its length that a sequence shares in words of a size with one of the identity, such that the tolerance's part of the pairs share that much. It never falls with the identity.

    seqs: (seq_id, seq) in ``letters``. The sample takes ``sample`` sequences of at least SHORTEST letters by a seeded hash of the id.
    """
    rows = seqs.filter(F.length("seq") >= SHORTEST).select("seq_id", "seq", F.xxhash64(F.lit(seed), F.col("seq_id").cast("string")).alias("h"))
    rows = rows.orderBy("h", "seq_id").limit(sample).repartition("h")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, seq in zip(batch["h"].tolist(), batch["seq"]):
                rng = np.random.default_rng([seed, h & 0xFFFF_FFFF])
                a = np.minimum(letter_numbers(seq, letters), len(letters) - 1)
                for percent in PERCENTS:
                    b = changed(a, percent, len(letters), rng)
                    out += [(percent, size, 100.0 * shared_words(a, b, size) / len(a)) for size in SIZES]
            yield pd.DataFrame(out, columns=["identity", "size", "share"])

    found = rows.mapInPandas(measure, "identity int, size int, share double")
    parts = F.array(*[F.lit(round(1 - c, 6)) for c in COVERS])
    table = found.groupBy("identity", "size").agg(F.percentile("share", parts).alias("p")).select("identity", "size", F.posexplode("p").alias("t", "share"))
    rising = F.max("share").over(Window.partitionBy("t", "size").orderBy("identity").rowsBetween(Window.unboundedPreceding, 0))
    return table.select((F.col("t") + 1).alias("tolerance"), "identity", "size", rising.alias("share"))


def as_option(shares: DataFrame) -> tuple[tuple[tuple[float, ...], ...], ...]:
    """The table (61 identities, 4 word lengths, 5 tolerances) in the form of Options.observed_shares."""
    at = {(r["tolerance"], r["identity"], r["size"]): r["share"] for r in shares.collect()}
    return tuple(tuple(tuple(at[t, p, s] for s in SIZES) for p in PERCENTS) for t in range(1, len(COVERS) + 1))
