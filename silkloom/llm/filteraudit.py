"""Filter interaction audit: what five filters remove alone, together and in every order.

Each document gets a mask with one bit per filter that it fails. Four bits come from its own text; the fifth, for exact
copies, from an RDD that is routed by a fingerprint of the text: a partition keeps a chain of full texts for each
fingerprint, so that texts whose fingerprints collide stay apart, and each text keeps its smallest id. Rows with other
ids of that text fail. Tasks chain their own rows first, so a text moves once from each task, however many copies it has.
The masks are then counted into one vector per part, and every order of the filters is read off the vectors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, task

#: Fixed values of the contract.
FILTERS = "ABCDE"
MIN_WORDS = 200
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MASKS = 1 << len(FILTERS)

#: Bytes of texts that a task chains before it sends them on, and that a partition of fingerprints holds on average.
HELD, PARTITION = 32 << 20, 48 << 20
#: Rows with a known mask that a task counts before it sends them on.
KNOWN = 50_000


def failures(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(s in text for s in SIGNS))
    return sum(1 << i for i, f in enumerate(failed) if f)


def fingerprint(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class Chains:
    """Texts by fingerprint, each with its smallest id, its bits and, by part, the number of rows of that id."""

    def __init__(self):
        self.at: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: str, ident, bits: int, parts: dict[str, int]) -> list[tuple]:
        """Takes rows of one id; returns the rows (id, part, bits, n) that now are known not to have the smallest id."""
        chain = self.at.setdefault(key, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, ident, bits, dict(parts)])
            self.bytes += 2 * len(text) + 400
            return []
        if ident == entry[1]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return []
        lost = (ident, parts) if ident > entry[1] else (entry[1], entry[3])
        if ident < entry[1]:
            entry[1], entry[3] = ident, dict(parts)
        return [(lost[0], part, bits | BIT["E"], n) for part, n in lost[1].items()]

    def least(self) -> Iterator[tuple[int, tuple]]:
        """(fingerprint, (text, id, bits, parts)) of every text; the chains are empty after it."""
        at, self.at, self.bytes = self.at, {}, 0
        for key, chain in at.items():
            yield from ((key, tuple(e)) for e in chain)


def routed(rows: Iterable[tuple], key_of: Callable[[str], int]) -> Iterator[tuple[int, tuple]]:
    """From rows (id, text, part) to records by the key that they are dealt by: texts with their smallest id by fingerprint; rows whose mask is known, counted, by a hash of what they say."""
    with task():
        chains, known = Chains(), Counter()
        for ident, text, part in rows:
            bits = failures(text)
            for *row, n in [(None, part, bits, 1)] if ident is None else chains.add(key_of(text), text, ident, bits, {part: 1}):
                known[tuple(row)] += n
            if len(known) > KNOWN:
                yield from counted(known)
            if chains.bytes > HELD:
                yield from chains.least()
        yield from counted(known)
        yield from chains.least()


def counted(known: Counter) -> Iterator[tuple[int, tuple]]:
    """The records of counted rows; the counter is empty after it. Keys follow from the rows alone, so a task that is run again deals alike."""
    now = list(known.items())
    known.clear()
    yield from ((xxhash.xxh3_64_intdigest(repr(row)), (None, *row, n)) for row, n in now)


def settled(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, part, bits, n) of the records that were dealt to a partition, with the bit of filter E."""
    with task():
        chains = Chains()
        for key, (text, *rest) in records:
            yield from [tuple(rest)] if text is None else chains.add(key, text, *rest)
        for _, (_, ident, bits, parts) in chains.least():
            yield from ((ident, part, bits, n) for part, n in parts.items())


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", key_of: Callable[[str], int] = fingerprint) -> DataFrame:
    """(id, part, bits, n): how many rows of an id and a part have a mask.

    A null text is an empty one, a null part the empty string. A row with a null id is compared with no other: it never
    fails E. Rows alike in id and text do not fail E through each other. Texts of any length are judged whole. An
    empty table gives no rows; columns of docs cannot clash, as three are taken by name.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")))
    size = rows.agg(F.sum(F.octet_length(rows.columns[1])).cast("long")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION))
    found = rows.rdd.mapPartitions(lambda it: routed(it, key_of)).partitionBy(parts, lambda key: key).mapPartitions(settled)
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("bits", T.IntegerType()), T.StructField("n", T.LongType())])
    return docs.sparkSession.createDataFrame(found, kind, verifySchema=False).groupBy("id", "part", "bits").agg(F.sum("n").alias("n"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of rows whose text some row with a smaller id has, once each."""
    found = masks(docs, id_col, text_col, text_col).filter(F.col("bits").bitwiseAND(F.lit(BIT["E"])) != 0)
    return found.select(F.col("id").alias(id_col)).distinct()


def _added(vector: np.ndarray, row: tuple) -> np.ndarray:
    bits, n, good, toxic = row
    vector[bits] += (n, n * good, n * toxic)
    return vector


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def orders(part: str, vector: np.ndarray) -> list[tuple]:
    """The rows of a part, from its vector: of each mask the number of documents, of good ones and of toxic ones."""
    of = np.arange(MASKS)
    fails = {name: of & bit > 0 for name, bit in BIT.items()}
    out, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        live = np.ones(MASKS, bool)
        for step, name in enumerate(order, 1):
            here, before = fails[name] & live, fails[name] & ~live
            live &= ~here
            removed, good, toxic = vector[here].sum(0).tolist()
            shapley[name] += removed
            out.append(("".join(order), step, int(vector[live, 0].sum()), removed, int(vector[before, 0].sum()), int(vector[BIT[name], 0]), good, toxic))
    return [(part, *r, shapley[r[0][r[1] - 1]]) for r in out]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", key_of: Callable[[str], int] = fingerprint) -> DataFrame:
    """One row per part, order of the filters and step, with the columns of AUDIT.

    labels is (doc_id, quality, toxic): a document is good or toxic if some row of its id says 1; nulls and ids that
    are not there say nothing. masks() tells how nulls, repeated rows and empty tables count.
    """
    found = masks(docs, id_col, text_col, part_col, key_of)
    is_one = lambda c: F.max((F.col(c) == 1).cast("int"))
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = found.join(said, "id", "left").select("part", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: _added(np.zeros((MASKS, 3), np.int64), row), _added, _merged)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), AUDIT, verifySchema=False)


def op11_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}

ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS f
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
i(x) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, o, x AS step, o[x] AS here, n, good, toxic, f[o[x]] AS fails, list_bool_or(list_transform(range(1, x), lambda k: f[o[k]])) AS gone,
             list_sum(list_transform(f, lambda v: v::INT)) = 1 AS sole FROM c, o, i),
r AS (SELECT part, o, step, here,
             sum(n) FILTER (NOT fails AND NOT coalesce(gone, false)) AS kept, sum(n) FILTER (fails AND NOT coalesce(gone, false)) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
             sum(n) FILTER (fails AND sole) AS unique_fails, sum(good) FILTER (fails AND NOT coalesce(gone, false)) AS good_lost, sum(toxic) FILTER (fails AND NOT coalesce(gone, false)) AS toxic_lost
      FROM s GROUP BY part, o, step, here)
SELECT part, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, here), 0) AS BIGINT) AS shapley
FROM r
"""
}
