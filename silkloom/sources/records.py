"""FASTA and FASTQ through Spark's text reader, so files may lie in any store and compress by any codec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import identifier, letters, merged_pair
from ..plans.numbering import numbered, numbered_in_files
from ..plans.storage import stored, temporary


def _named(header: Column) -> list[Column]:
    head = F.regexp_replace(header, r"^[ \t]|\r$", "")
    return [F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*\s?(.*)$", 1)).alias("comment")]


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(value, file, start): what lies between separators, with the file and the offset of the split that it was read from."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", sep).text(path).select("value", *at)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, comment, sequence, quality null): one row per record. Records are split at a > that begins a line; sequences may span lines."""
    raw = _pieces(spark, path, "\n>").filter(F.length(F.regexp_replace("value", r"\s", "")) > 0)
    raw = numbered_in_files(raw.withColumn("value", F.regexp_replace("value", "^>", "")))
    head, body = F.substring_index("value", "\n", 1), F.regexp_replace(F.col("value"), r"^[^\n]*\n?", "")
    return raw.select("ordinal", *_named(head), F.regexp_replace(body, r"\s", "").alias("sequence"), F.lit(None).cast("string").alias("quality"))


#: Splits whose states are broadcast; beyond that many they are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def _measures(piece: str) -> tuple[int, int]:
    """(letters, quality letters) of the record that begins with a piece; letters are -1 without a quality part, and -2 for a blank piece."""
    if not piece.strip():
        return -2, 0
    _, _, rest = piece.removeprefix("@").partition("\n")
    seq, plus, tail = rest.partition("\n+") if not rest.startswith("+") else ("", "+", rest[1:])
    return (len("".join(seq.split())), len("".join(tail.partition("\n")[2].split()))) if plus else (-1, 0)


BROKEN = -1


def _exits(pieces: list[str]) -> tuple[np.ndarray, list[int]]:
    """(upto, exits): the quality letters of the first so many pieces, and the state at the end of a split for a parser that begins a record at each piece.

    A state is how many quality letters the record that is begun still needs (0: none is begun); BROKEN: what lies
    there is no record. A piece that goes on with a quality counts its @ too.
    """
    upto = np.concatenate([[0], np.cumsum([1 + len("".join(p.split())) for p in pieces], dtype=np.int64)]).astype(np.int64)
    exits = [0] * (len(pieces) + 1)
    for j in range(len(pieces) - 1, -1, -1):
        letters, quality = _measures(pieces[j])
        rest = letters - quality
        if letters == -2 or letters >= 0 and rest == 0:
            exits[j] = exits[j + 1]
        elif letters < 0 or rest < 0:
            exits[j] = BROKEN
        else:
            target = int(upto[j + 1]) + rest
            k = int(np.searchsorted(upto, target))
            exits[j] = target - int(upto[-1]) if target > upto[-1] else exits[k] if upto[k] == target else BROKEN
    return upto, exits


def _split_states(raw: DataFrame) -> DataFrame:
    """(file, start, state): the parser's state at the begin of each split. Splits are summed up apart, and only the sums are gone through in file order."""

    def summed(at: tuple, pieces: list[str]) -> tuple:
        upto, exits = _exits(pieces)
        usual = max(set(exits), key=exits.count)
        odd = [(int(u), e) for u, e in zip(upto, exits) if e != usual]
        return (*at, int(upto[-1]), usual, [u for u, _ in odd], [e for _, e in odd])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pieces = None, []
        for batch in batches:
            out = []
            for *at, value in zip(batch["file"], batch["start"].tolist(), batch["value"]):
                if tuple(at) != now:
                    if now:
                        out.append(summed(now, pieces))
                    now, pieces = tuple(at), []
                pieces.append(value)
            yield pd.DataFrame(out, columns=["file", "start", "letters", "usual", "keys", "ends"])
        if now:
            yield pd.DataFrame([summed(now, pieces)], columns=["file", "start", "letters", "usual", "keys", "ends"])

    def states(splits: pd.DataFrame) -> pd.DataFrame:
        out, state = [], 0
        for file, start, letters, usual, keys, ends in splits.sort_values("start").itertuples(index=False):
            out.append((file, start, state))
            state = state - letters if state > letters else dict(zip(keys, ends)).get(state, usual)
            if state == BROKEN:
                raise ValueError(f"{file}: at {start} or after it, a record has no quality, or one longer than its sequence")
        if state:
            raise ValueError(f"{file}: a record's quality is shorter than its sequence")
        return pd.DataFrame(out, columns=["file", "start", "state"])

    told = raw.select("file", "start", "value").mapInPandas(sums, "file string, start long, letters long, usual long, keys array<long>, ends array<long>")
    return told.groupBy("file").applyInPandas(states, "file string, start long, state long")


def _record(text: str) -> tuple[str, str, str]:
    """(head, sequence, quality) of a whole record."""
    head, _, rest = text.removeprefix("@").partition("\n")
    seq, _, tail = rest.partition("\n+") if not rest.startswith("+") else ("", "+", rest[1:])
    return head, "".join(seq.split()), "".join(tail.partition("\n")[2].split())


_PARSED = ["file", "start", "at", "head", "sequence", "quality", "part"]


def _parsed(rows: DataFrame) -> DataFrame:
    """The records of each split (part null), what the split adds to a record begun before it (part: the text, at -1), and the record that it leaves unfinished (part: the text)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, need, held, entering = None, 0, 0, [], False
        for batch in batches:
            out = []
            for file, start, state, piece in zip(batch["file"], batch["start"].tolist(), batch["state"].tolist(), batch["value"]):
                if (file, start) != now:
                    if held:
                        out.append((*now, -1 if entering else at, None, None, None, "\n@".join(held)))
                    now, at, need, held, entering = (file, start), 0, state, [], state > 0
                if need:  # a quality goes on
                    held.append(piece)
                    need -= 1 + len("".join(piece.split()))
                    if need < 0:
                        raise ValueError(f"{file}: the quality of a record is longer than its sequence")
                    if need == 0:
                        text, held = "\n@".join(held), []
                        out.append((file, start, -1, None, None, None, text) if entering else (file, start, at, *_record(text), None))
                        at, entering = at + (not entering), False
                    continue
                letters, quality = _measures(piece)
                if letters == -2:
                    continue
                if letters < 0 or quality > letters:
                    raise ValueError(f"{file}: a record has no quality, or one longer than its sequence")
                need = letters - quality
                if need:
                    held = [piece]
                else:
                    out.append((file, start, at, *_record(piece), None))
                    at += 1
            yield pd.DataFrame(out, columns=_PARSED)
        if held:
            yield pd.DataFrame([(*now, -1 if entering else at, None, None, None, "\n@".join(held))], columns=_PARSED)

    return rows.select("file", "start", "state", "value").mapInPandas(parse, "file string, start long, at long, head string, sequence string, quality string, part string")


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """The records of a file that lie in several splits, from their parts; each has the place at which it begins."""
    out, begun, text = [], None, []
    for file, start, at, part in parts.sort_values(["start", "at"])[["file", "start", "at", "part"]].itertuples(index=False):
        if at >= 0:
            if begun:
                out.append((*begun, *_record("\n@".join(text)), None))
            begun, text = (file, start, at), [part]
        else:
            text.append(part)
    if begun:
        out.append((*begun, *_record("\n@".join(text)), None))
    return pd.DataFrame(out, columns=_PARSED)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, comment, sequence, quality). Sequence and quality may span lines; a quality ends by its length.

    A quality line may begin with @, so only the records before a line tell whether it begins one. Each split is
    therefore summed up for every state that a parser may be in as it comes there; the sums, taken in file order, give each
    split its true state; and the splits are parsed apart. Records that lie across splits are put together from
    their parts. A quality of another length than its sequence is an error, and so is a record without one.
    """
    with temporary(spark) as tables:
        raw = _pieces(spark, path, "\n@")
        states = tables(_split_states(raw), "states")
        if states.count() <= BROADCAST_SPLITS:
            rows = raw.join(F.broadcast(states), ["file", "start"])  # rows stay where they are, in order
        else:
            rows = raw.withColumn("_m", F.monotonically_increasing_id()).join(states, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "_m")
        found = tables(_parsed(rows), "parsed")
        parts = found.filter("part is not null").groupBy("file").applyInPandas(_joined, found.schema)
        whole = found.filter("part is null").unionByName(parts)
        before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
        starts = whole.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        named = whole.join(starts, ["file", "start"]).withColumn("ordinal", F.col("before") + F.col("at"))
        return stored(named.select("ordinal", *_named(F.col("head")), "sequence", "quality"), "fastq")


def kept_records(records: DataFrame, min_length: int = 10, id_length: int = 20, most: int = 0) -> DataFrame:
    """(seq_id, identifier, seq) of records whose letters are more than min_length; the first ``most`` (0: all)."""
    named = records.filter(F.col("ordinal") < most) if most else records
    rows = named.select(F.col("ordinal").alias("seq_id"), identifier(F.concat(F.lit(">"), F.col("name")), id_length).alias("identifier"), letters(F.col("sequence")).alias("seq"))
    return rows.filter(F.length("seq") > min_length)


def paired(first: DataFrame, second: DataFrame, min_length: int = 10) -> DataFrame:
    """(seq_id, identifier, seq, r2_length): records of two files joined by place and merged. Files of unequal numbers of records are an error."""
    counts = first.agg(F.count(F.lit(1))).first()[0], second.agg(F.count(F.lit(1))).first()[0]
    if counts[0] != counts[1]:
        raise ValueError(f"the files have {counts[0]} and {counts[1]} records")
    a = first.select("ordinal", "name", letters(F.col("sequence")).alias("r1"))
    b = second.select("ordinal", letters(F.col("sequence")).alias("r2"))
    rows = a.join(b, "ordinal").filter(F.length("r1") + F.length("r2") > min_length)
    return rows.select(F.col("ordinal").alias("seq_id"), F.col("name").alias("identifier"), merged_pair(F.col("r1"), F.col("r2")).alias("seq"), F.length("r2").alias("r2_length"))


def in_memory(df: DataFrame, id_col: str, text_col: str, min_length: int = 10) -> DataFrame:
    """(seq_id, seq) from a table, as it is: longer than min_length letters, without any formatting."""
    return df.select(F.col(id_col).alias("seq_id"), F.col(text_col).alias("seq")).filter(F.length("seq") > min_length)


def in_memory_named(df: DataFrame, id_col: str, header_col: str, text_col: str, min_length: int = 10, id_length: int = 20) -> DataFrame:
    """(seq_id, identifier, seq): seq_id numbers the kept rows in the order of id_col."""
    kept = df.filter(F.length(text_col) > min_length)
    return numbered(kept, id_col, out="seq_id").select("seq_id", identifier(F.col(header_col), id_length).alias("identifier"), F.col(text_col).alias("seq"))
