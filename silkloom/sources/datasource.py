"""FASTA and FASTQ as data sources: ``spark.read.format("fasta").load(path)`` after ``register(spark)``.

Rows are (file, offset, length, name, comment, sequence, quality, letters); offset and length are the record's bytes in its
file, so that ``original()`` can copy it as it was. A plain FASTA file is cut into byte ranges of ``splitBytes``, each read
by a task of its own, and a record belongs to the range that its > lies in. FASTQ and gzip files are one task each;
``records.read_fastq`` splits plain FASTQ too, and the readers there take any store that Spark does, while these
open what Arrow's file systems do. Option ``minLength`` leaves out shorter records as they are read, and so do filters ``letters >
n`` and ``letters >= n``.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull

SCHEMA = "file string, offset long, length long, name string, comment string, sequence string, quality string, letters long"
#: Bytes of a range, and bytes that are read at a time.
SPLIT, CHUNK = 64 << 20, 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path names: itself, those of a folder, or those that match * in the last part."""
    fs, at = opened(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    folder, _, pattern = (at, "", "*") if info.type == pafs.FileType.Directory else at.rpartition("/")
    found = fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
    named = [f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
    if not named:
        raise FileNotFoundError(path)
    return [(prefix + f.path, f.size) for f in sorted(named, key=lambda f: f.path)]


def _header(line: bytes) -> tuple[str, str]:
    name, comment = re.fullmatch(r"[ \t]?(\S*)\s?(.*)", line.decode("utf-8", "replace").rstrip("\r\n"), re.DOTALL).groups()
    return name, comment.strip()


def _letters(lines: bytes) -> bytes:
    return b"".join(lines.split())


def fasta_records(chunks: Iterable[bytes], start: int, end: int | None) -> Iterator[tuple]:
    """(offset, length, header, sequence) of the records whose > is in [start, end); chunks begin a byte before ``start``, or at 0."""
    held, at = (b"", start - 1) if start else (b"\n", -1)  # as if a line ended before the first byte
    for chunk in chunks:
        held += chunk
        while True:
            first = held.find(b"\n>")
            if first < 0:
                held, at = held[-1:], at + max(0, len(held) - 1)  # nothing before the first record counts
                break
            if end is not None and at + first + 1 >= end:
                return
            upto = held.find(b"\n>", first + 1)
            if upto < 0:
                held, at = held[first:], at + first
                break
            yield at + first + 1, upto - first, *_fasta(held[first + 1 : upto + 1])
            held, at = held[upto:], at + upto
    first = held.find(b"\n>")
    if first >= 0 and (end is None or at + first + 1 < end):
        yield at + first + 1, len(held) - first - 1, *_fasta(held[first + 1 :])


def _fasta(record: bytes) -> tuple[bytes, bytes, None]:
    head, _, body = record[1:].partition(b"\n")
    return head, _letters(body), None


def fastq_records(lines: Iterator[bytes]) -> Iterator[tuple]:
    """(offset, length, header, sequence, quality) of the records of a file, line by line."""
    at = 0
    for line in lines:
        begin, size = at, len(line)
        at += size
        if not line.strip():
            continue
        if not line.startswith(b"@"):
            raise ValueError(f"no record begins at byte {begin}")
        seq, quality = [], b""
        for part in lines:
            at += len(part)
            if part.startswith(b"+"):
                break
            seq.append(part)
        else:
            raise ValueError(f"the record at byte {begin} has no quality")
        sequence = _letters(b"".join(seq))
        while len(quality) < len(sequence):
            part = next(lines, None)
            if part is None:
                raise ValueError(f"the quality of the record at byte {begin} is shorter than its sequence")
            at += len(part)
            quality += _letters(part)
        if not sequence:
            part = next(lines, b"")
            at += len(part)
            quality = _letters(part)
        if len(quality) > len(sequence):
            raise ValueError(f"the quality of the record at byte {begin} is longer than its sequence")
        yield begin, at - begin, line[1:], sequence, quality


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int | None


class RecordReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.least, self.split = int(options.get("minlength", 0)), int(options.get("splitbytes", SPLIT))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the data source's own name
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("letters",):
                self.least = max(self.least, int(f.value) + isinstance(f, GreaterThan))
            elif not (isinstance(f, IsNotNull) and f.attribute == ("letters",)):  # letters never are null
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for file, size in files(self.path):
            whole = self.kind == "fastq" or file.endswith(".gz") or size <= self.split
            out += [Range(file, 0, None)] if whole else [Range(file, i, min(i + self.split, size)) for i in range(0, size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, at = opened(partition.file)
        with fs.open_input_file(at) if not at.endswith(".gz") else fs.open_input_stream(at, compression=None) as f:
            stream = gzip.GzipFile(fileobj=f) if at.endswith(".gz") else f
            if self.kind == "fastq":
                found = fastq_records(_lines(_chunks(stream)))
            else:
                if partition.start:
                    stream.seek(partition.start - 1)
                found = fasta_records(_chunks(stream), partition.start, partition.end)
            for offset, length, head, sequence, quality in found:
                if len(sequence) >= self.least:
                    yield (partition.file, offset, length, *_header(head), sequence.decode("latin-1"), None if quality is None else quality.decode("latin-1"), len(sequence))


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def _lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Lines with their ends."""
    held = b""
    for chunk in chunks:
        *lines, held = (held + chunk).splitlines(keepends=True) if chunk else [held]
        if held.endswith(b"\n"):
            lines, held = [*lines, held], b""
        yield from lines
    if held:
        yield held


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.name(), {k.lower(): v for k, v in self.options.items()})


class FastqSource(FastaSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets Spark hand filters to Python data sources, which these readers need."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(FastqSource)


def original(records: DataFrame) -> DataFrame:
    """records (file, offset, length and other columns, of files that are not compressed) with ``record``: its bytes in the file, unchanged."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handles: dict = {}
        for batch in batches:
            out = []
            for file, offset, length in zip(batch["file"], batch["offset"].tolist(), batch["length"].tolist()):
                if file not in handles:
                    if len(handles) >= 64:
                        handles.pop(next(iter(handles))).close()
                    fs, at = opened(file)
                    handles[file] = fs.open_input_file(at)
                out.append(handles[file].read_at(length, offset))
            yield batch.assign(record=out)
        for f in handles.values():
            f.close()

    rows = records.repartition("file").sortWithinPartitions("file", "offset")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(read, f"{kinds}, record binary")
