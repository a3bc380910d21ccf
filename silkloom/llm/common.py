"""What several operators share: table reads, the shared folder, word counts and seeded keys."""

from __future__ import annotations

import ctypes
import platform
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Tables, scratch, stored, temporary  # noqa: F401  operators take these from here

#: A word is a maximal run of characters other than space, \t, \n, \x0b, \x0c and \r.
SPACES = " \t\n\x0b\x0c\r"


#: Rows of texts that a task turns into Python objects at a time. Spark bounds an Arrow batch by its bytes.
BATCH_ROWS = 256
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and platform.libc_ver()[0] == "glibc" else None


@contextmanager
def task(drop: Callable[[], None] | None = None) -> Iterator[None]:
    """A task in a Python worker, which drops its tables and returns its memory when it ends.

    Spark keeps more workers than tasks run at once and gives tasks to them in turn, so what idle ones hold adds up
    beside an executor's heap.
    """
    try:
        yield
    finally:
        if drop:
            drop()
        pa.default_memory_pool().release_unused()
        if _LIBC:
            _LIBC.malloc_trim(0)


def freeing(run: Callable, drop: Callable[[], None] | None = None) -> Callable:
    """A function of batches for mapInArrow, run as a task()."""

    def freed(batches):
        with task(drop):
            yield from run(batches)

    return freed


def slices(batches: Iterable[pa.RecordBatch | pa.Array], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch | pa.Array]:
    """Arrow batches or arrays in slices of so many rows, which copy nothing."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def by_slices(arrays: Iterable[pa.Array], values: Callable[[list], list], kind: pa.DataType) -> Iterator[pa.Array]:
    """For an Arrow UDF: values(list of Python values) for each slice, put together to one array per batch."""
    for array in arrays:
        parts = [pa.array(values(part.to_pylist()), kind) for part in slices([array])]
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_word_count(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the number of words of a text column (null: 0), counted without regular expressions for most texts.

    White space is made plain spaces and trimmed; where no two spaces touch, words are spaces plus one. Only texts
    with longer gaps go through the regular expression.
    """
    s = F.coalesce(F.col(text), F.lit(""))
    for ch in SPACES[1:]:
        s = F.replace(s, F.lit(ch), F.lit(" "))
    t = F.col("_llm_plain")
    n = (
        F.when(F.octet_length(t) == 0, F.lit(0))
        .when(F.contains(t, F.lit("  ")), F.regexp_count(t, F.lit(r"\S+")))
        .otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    )
    return df.withColumn("_llm_plain", F.trim(s)).withColumn(out, n.cast("long")).drop("_llm_plain")


def seeded_key(seed: int, ident: Column, text: Column) -> Column:
    """A hexadecimal key that orders rows at random: it depends on the seed, the row's id and its text only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))))


def leading_bits(key: Column) -> Column:
    """The first 32 bits of a hexadecimal key as a long."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def buckets_for(rows: int, bucket_rows: int) -> int:
    """So many hash buckets that each holds bucket_rows rows at most, on average."""
    return max(1, -(-rows // bucket_rows))
