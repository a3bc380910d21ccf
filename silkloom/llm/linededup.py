"""Line dedup by winnowing over line hashes.

Lines with words are hashed. A gram is the shortest run of lines from a line on with at least GRAM words; in each
shortest run with at least RUN words, the gram with the smallest hash is selected as a fingerprint. So every run of RUN
words that two places share has a fingerprint in common (winnowing's guarantee), and few lines are fingerprints.

Positions are joined by fingerprint. Around those that are shared, a match is extended both ways window by window: each
window (a shortest run of RUN words from a line on, or up to a line) that holds the fingerprint is joined with its own
first occurrence, so an extension does not depend on which earlier place a fingerprint met first. Windows that
occurred before are deleted. The rule that comes out is exact: a line goes if it lies in a run of at least RUN words
that occurs earlier, in a document with a smaller id or before it in its own. Windows are told apart by 128-bit hashes
of the 128-bit hashes of their lines, so a chance equality need not be looked for even among 10^15 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, slices, stored, table, task, temporary, with_word_count

#: Words of a fingerprint's gram, and words from which on a repeated run is deleted.
GRAM, RUN = 25, 50
#: A hash that more than one in so many rows holds is common. There are fewer common ones than that, so they are sent to all tasks.
COMMON = 20_000


def lines_of(text: str) -> list[tuple[int, str, int]]:
    """(number, line, words) of the \\n-split lines that hold a word."""
    out = []
    for i, line in enumerate(text.split("\n")):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            out.append((i, line, n))
    return out


def reach(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end of the shortest run from it with at least so many words; len + 1 where there is none."""
    upto = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(upto, upto[:-1] + least)


def select(hashes: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int]]:
    """Fingerprints (hash, start, end) of a document's lines; hashes: 16 bytes a line."""
    n = len(hashes)
    if not n or words.sum() < RUN:
        return []
    ends, stops = reach(words, GRAM), reach(words, RUN)
    grams = [xxhash.xxh64_intdigest(hashes[i:e].tobytes()) - (1 << 63) if e <= n else None for i, e in enumerate(ends.tolist())]
    chosen = set()
    for i, stop in enumerate(stops.tolist()):
        if stop > n:
            break
        inside = [(grams[j], -j) for j in range(i, stop) if ends[j] <= stop]
        chosen.add(-min(inside)[1])
    return [(grams[i], i, int(ends[i])) for i in sorted(chosen)]


def windows(hashes: np.ndarray, words: np.ndarray, shared: list[tuple[int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Windows (hash, start, end) of RUN words that hold one of the shared grams (start, end)."""
    n = len(hashes)
    upto = np.concatenate([[0], np.cumsum(words)])
    ahead = [(i, e) for i, e in enumerate(reach(words, RUN).tolist()) if e <= n]
    back = [(int(np.searchsorted(upto, upto[e] - RUN, "right")) - 1, e) for e in range(1, n + 1) if upto[e] >= RUN]
    starts = np.array(sorted(s for s, _ in shared))
    least_end = np.minimum.accumulate(np.array([e for _, e in sorted(shared)])[::-1])[::-1]
    for s, e in sorted({*ahead, *back}):
        at = int(np.searchsorted(starts, s))
        if at < len(starts) and least_end[at] <= e:
            yield xxhash.xxh3_128_digest(hashes[s:e].tobytes()), s, e


_LINE = "V16"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, d, h, hashes, words, prints) of (key, d, h, text); texts without a fingerprint are left out."""
    span = pa.struct([("hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in slices(batches):
        at, rows = [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            lines = lines_of(text or "")
            words = np.array([n for *_, n in lines], np.int32)
            if words.sum() < RUN:
                continue
            hashes = np.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for _, x, _ in lines], _LINE)
            prints = select(hashes, words)
            if prints:
                at.append(i)
                rows.append((hashes.tobytes(), words.tobytes(), [{"hash": h, "start": s, "end": e} for h, s, e in prints]))
        hashes, words, prints = zip(*rows) if rows else ((), (), ())
        kept = batch.take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1), kept.column(2), pa.array(hashes, pa.binary()), pa.array(words, pa.binary()), pa.array(prints, pa.list_(span))],
            names=["key", "d", "h", "hashes", "words", "prints"],
        )


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, d, h, hash, start, end): the windows around shared fingerprints of (key, d, h, hashes, words, shared)."""
    for batch in slices(batches):
        at, found = [], []
        for i, (hashes, words, shared) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
            got = windows(np.frombuffer(hashes, _LINE), np.frombuffer(words, np.int32), [(g["start"], g["end"]) for g in shared])
            before = len(found)
            found.extend(got)
            at.extend([i] * (len(found) - before))
        hashes, starts, ends = zip(*found) if found else ((), (), ())
        kept = batch.take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1), kept.column(2), pa.array(hashes, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["key", "d", "h", "hash", "start", "end"],
        )


_CUT = pa.struct([("text", pa.string()), ("lines", pa.int64()), ("deleted", pa.int64())])


def _without(text: str | None, gone: list | None) -> dict:
    """A text without the lines of its deleted spans (line numbers among those with words); how many it had and lost."""
    lines = lines_of(text or "")
    drop = {i for g in gone or () for i in range(g["start"], g["end"])}
    if drop:
        numbers = {lines[i][0] for i in drop}
        text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers)
    return {"text": text, "lines": len(lines), "deleted": len(drop)}


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.LongType()), T.StructField("deleted", T.LongType())]))
def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    with task():
        for texts, spans in batches:
            parts = [pa.array([_without(t, g) for t, g in zip(a.to_pylist(), b.to_pylist())], _CUT) for a, b in zip(slices([texts]), slices([spans]))]
            yield pa.concat_arrays(parts) if parts else pa.array([], _CUT)


def _of_hash(rows: DataFrame, found: DataFrame, total: int, how: str) -> DataFrame:
    """rows joined with ``found``, one row (hash, n, ...) per hash that n of all ``total`` rows hold. Common hashes are sent to all tasks, so no task gets all rows of one."""
    least = max(256, total // COMMON)
    common, others = F.broadcast(found.filter(F.col("n") > least)), found.filter(F.col("n") <= least)
    rest = rows.join(common.select("hash"), "hash", "left_anti")
    return rows.join(common, "hash", how).unionByName(rest.join(others, "hash", how))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row`` (struct of docs' columns), ``text`` without repeated runs, ``lines`` with words and ``deleted`` ones, for each row of docs.

    Documents come by doc_id (null first), then by a hash of the text. Rows alike in both are one document: all keep or
    lose the same lines. Runs that overlap their own first occurrence stay. Null texts stay null; texts of any length
    are taken whole; an empty table gives an empty result. Columns of docs cannot clash, as they stay inside ``row``.
    """
    at = [F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]
    key = F.concat_ws(":", F.coalesce(F.col("d").cast("string"), F.lit("n")), F.col("h")).alias("key")
    with temporary(docs.sparkSession) as tables:
        texts = docs.select(*at, "text").select(key, "d", "h", "text")
        span = "struct<hash: long, start: int, end: int>"
        signed = tables(texts.mapInArrow(freeing(_signed), f"key string, d long, h long, hashes binary, words binary, prints array<{span}>"), "lines")

        prints = signed.select("key", F.explode("prints").alias("p")).select("key", "p.*")
        met = tables(prints.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
        total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shared = _of_hash(prints, met, total, "left_semi").groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("shared"))
        around = signed.select("key", "d", "h", "hashes", "words").join(shared, "key")
        around = tables(around.mapInArrow(freeing(_extended), "key string, d long, h long, hash binary, start int, end int").distinct(), "windows")
        place = F.struct("d", "h", "start", "end")
        first = tables(around.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
        total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        again = _of_hash(around, first, total, "inner")
        same = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("h") == F.col("first.h"))
        spans = again.filter(~same | (F.col("start") >= F.col("first.end"))).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
        spans = stored(spans, "spans")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *at).select("row", key)
    out = rows.join(spans, "key", "left").select("row", cut(F.col("row.text"), F.col("gone")).alias("c"))
    return out.select("row", "c.text", "c.lines", "c.deleted")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with their columns, repeated runs deleted and n_chars (where there is such a column) counted anew. Documents that lost their last words go."""
    out = with_word_count(dedup_lines(docs), "text", "left").filter((F.col("deleted") == 0) | (F.col("left") > 0))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


def op8_line_winnowing(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "text", "lines", "deleted")


QUERIES = {"op8_line_winnowing": op8_line_winnowing}

ORACLE_SQL = {
    "op8_line_winnowing": r"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
b AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM a),
l AS (SELECT doc_id, no, line, words, row_number() OVER o AS i, sum(words) OVER o AS upto FROM b WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
f AS (SELECT x.doc_id, x.i AS s, min(y.i) AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.words >= 50 GROUP BY ALL),
g AS (SELECT y.doc_id, max(x.i) AS s, y.i AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.words >= 50 GROUP BY y.doc_id, y.i),
w AS (SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM g),
c AS (SELECT w.doc_id, s, e, md5(string_agg(line, chr(10) ORDER BY i)) AS h FROM w JOIN l ON w.doc_id = l.doc_id AND i BETWEEN s AND e GROUP BY ALL),
d AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(e) OVER o AS e0 FROM c WINDOW o AS (PARTITION BY h ORDER BY doc_id, s)),
gone AS (SELECT DISTINCT d.doc_id, no FROM d JOIN l ON d.doc_id = l.doc_id AND i BETWEEN s AND e WHERE d.doc_id <> d0 OR s > e0),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (gone.no IS NULL) AS kept, count(*) FILTER (words > 0) AS lines, count(gone.no) AS deleted
      FROM b LEFT JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, coalesce(kept, '') AS text, lines, deleted FROM k
"""
}
