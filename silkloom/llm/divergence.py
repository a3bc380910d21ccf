"""Source divergence audit: how differently the sources of a language use its terms.

Terms are dealt to blocks by hash. A block becomes a dense tile, groups by terms, of whole numbers: each group's share
of a term in billionths. All pairs of groups are compared on the tile by broadcasting, a stretch of groups against all of
them, and each task sums its tiles' pair matrices; each group's largest terms go to a heap. Spark then sums the partial
matrices and merges the heaps. A tile's size is bounded: the more groups a language has, the fewer terms a block holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, freeing, slices, stored, table, temporary

#: Fixed values of the contract.
LEAST_DOCS, SCALE, RANKS = 10, 1_000_000_000, 10
#: Every byte of a term as it counts, every other as a space.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Terms that a task counts before it sends them on, cells of a tile, and cells that are compared at a time.
HELD, CELLS, COMPARED = 400_000, 1 << 16, 1 << 20


def terms(text: str) -> list[bytes]:
    """The terms of a text: runs of letters A to Z, lower-cased, and of all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def shares(count: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 * vocabulary)), exactly: long division by three decimals at a time, which stays within 64 bits for all counts below 2 ** 53."""
    whole = n + 2 * vocabulary
    out, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most a billion and one, so the square fits 64 bits."""
    d = p - q
    return d * d // (p + q)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): counts of a task's stretch of documents, many rows to a term; each group also has a row with the empty term."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def sent(held: dict) -> pa.RecordBatch:
        flat = [(*group, term, n, d) for group, of in held.items() for term, (n, d) in of.items()]
        held.clear()
        columns = list(zip(*flat)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                of = held.setdefault((lang, source), {b"": [0, 0]})
                size -= len(of)
                own: dict[bytes, int] = {}
                for t in terms(text):
                    own[t] = own.get(t, 0) + 1
                for t, n in own.items():
                    if t in of:
                        of[t][0] += n
                        of[t][1] += 1
                    else:
                        of[t] = [n, 1]
                size += len(of)
                if size > HELD:
                    yield sent(held)
                    size = 0
        yield sent(held)

    return rows.mapInArrow(freeing(count), "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of the terms that at least so many documents of the language hold; the empty term, which stands for the group, stays."""
    grouped = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return grouped.withColumn("of_lang", of_lang).filter((F.col("of_lang") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n")


class Tile:
    """A block's terms by groups, as they come: first the groups with their sums, then counts."""

    def __init__(self, lang: str, vocabulary: int):
        self.lang, self.vocabulary = lang, vocabulary
        self.sources: list[str] = []
        self.sums: list[int] = []
        self.columns: dict[str, int] = {}
        self.cells: list[tuple[int, int, int]] = []

    def shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts by group and term, each group's shares, and the language's."""
        count = np.zeros((len(self.sources), len(self.columns)), np.int64)
        if self.cells:
            row, column, n = np.array(self.cells, np.int64).T
            count[row, column] = n
        sums = np.array(self.sums, np.int64)
        return count, shares(count, sums[:, None], self.vocabulary), shares(count.sum(0), sums.sum(), self.vocabulary)


class Sums:
    """The pair matrix and the heaps of one language's groups in a task."""

    def __init__(self, tile: Tile):
        self.lang, self.sources = tile.lang, tile.sources
        size = len(tile.sources)
        self.pairs = np.zeros((size, size), np.int64)
        self.heaps: list[list[tuple]] = [[] for _ in range(size)]

    def add(self, tile: Tile, ranks: int) -> None:
        count, p, q = tile.shares()
        size, width = p.shape
        if not width:
            return
        step = max(1, COMPARED // (size * width))
        for at in range(0, size, step):
            self.pairs[at : at + step] += distances(p[at : at + step, None, :], p[None, :, :]).sum(2)
        names = list(tile.columns)
        value = distances(p, q[None, :])
        for g in range(size):
            at = np.flatnonzero((count[g] > 0) & (p[g] > q))
            v = value[g, at]
            if len(at) > ranks:  # what is below the last rank's value cannot be in the heap; ties stay
                last = np.partition(v, len(v) - ranks)[len(v) - ranks]
                at, v = at[v >= last], v[v >= last]
            mine = [(-x, names[i].encode(), x) for i, x in zip(at.tolist(), v.tolist())]
            self.heaps[g] = heapq.nsmallest(ranks, self.heaps[g] + mine)

    def rows(self) -> pa.RecordBatch:
        out = [(self.lang, a, "pair", b, int(self.pairs[i, j])) for i, a in enumerate(self.sources) for j, b in enumerate(self.sources) if i != j]
        out += [(self.lang, a, "term", name.decode(), x) for a, heap in zip(self.sources, self.heaps) for _, name, x in heap]
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "part", "item", "value"])


def tiles(kept: DataFrame, tables: Tables) -> DataFrame:
    """(lang, block, tag, vocabulary, source, term, n), a task's rows by block, groups (tag 0, n: their sum) before counts (tag 1)."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count_distinct(F.when(F.col("term") != "", F.col("term"))).alias("vocabulary"), F.count_distinct("source").alias("g"))
    width = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("g")))
    sizes = tables(sizes.select("lang", "vocabulary", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / width)).cast("long").alias("blocks")), "sizes")
    heads = groups.join(sizes, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = kept.filter("term <> ''").join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    cols = lambda tag, term: ["lang", "block", F.lit(tag).alias("tag"), "vocabulary", "source", term.alias("term"), "n"]
    rows = heads.select(*cols(0, F.lit(""))).unionByName(cells.select(*cols(1, F.col("term"))))
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "lang", "block").sortWithinPartitions("lang", "block", "tag", "source")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): each source of a language against the others (part ``pair``) and its terms that stand out most (``term``).

    Null texts, languages and sources count as empty ones; empty texts have no terms, and groups without terms have
    their pairs all the same. Repeated rows count again. Texts of any length are counted whole. Ties go by the item's
    bytes. An empty table gives no rows; columns of docs cannot clash, as three are taken by name.
    """
    with temporary(docs.sparkSession) as tables:
        kept = tables(kept_terms(term_counts(docs, text_col, lang_col, source_col), least), "terms")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, sums, now = None, None, None

            def closed(tile: Tile | None) -> Sums | None:
                if tile is None:
                    return sums
                into = sums or Sums(tile)
                into.add(tile, ranks)
                return into

            for batch in slices(batches, 4096):
                for lang, block, tag, vocabulary, source, term, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if (lang, block) != now:
                        sums = closed(tile)
                        if sums is not None and sums.lang != lang:
                            yield sums.rows()
                            sums = None
                        now, tile, place = (lang, block), Tile(lang, vocabulary), {}
                    if tag == 0:
                        place[source] = len(tile.sources)
                        tile.sources.append(source)
                        tile.sums.append(n)
                    else:
                        tile.cells.append((place[source], tile.columns.setdefault(term, len(tile.columns)), n))
            sums = closed(tile)
            if sums is not None:
                yield sums.rows()

        found = tiles(kept, tables).mapInArrow(freeing(compare), "lang string, source string, part string, item string, value long")
        merged = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block, a pair in many
        place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        out = merged.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
        return stored(out, "divergence")


def op13_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}

ORACLE_SQL = {
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
gk AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM gk JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(c) AS c FROM gk GROUP BY ALL),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)::HUGEINT) // (sum(c) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM lc JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM gp JOIN lp USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
}
