"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BREAKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z and nothing else.
FOLD = str.maketrans(UPPER, UPPER.lower())
#: Turns the ASCII white space that separates words into blanks.
_BREAKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text; none for a null or an empty text."""
    return [w for w in (text or "").translate(FOLD).translate(_BREAKS).split(" ") if w]


def fold(c: Column) -> Column:
    """Lower-case A-Z in a column and leave every other character."""
    return F.translate(c, UPPER, UPPER.lower())


#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise: two workers share an executor.
BATCH = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where unset and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give back to the system what this worker has freed: workers are kept from task to task, and so would their peaks be."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of a column: at least one row, 16,384 at most, every row once."""
    release()
    for batch in batches:
        start, size = 0, 0
        lengths = batch.column(column)
        lengths = pc.binary_length(lengths).to_pylist()
        for i, n in enumerate(lengths):
            if (size and size + (n or 0) > limit) or i - start >= 16_384:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def packed(at: np.ndarray, bits: int) -> bytes:
    """A slice of 2^bits bits in which those at the given places, in order, are set, compressed where it was made: it travels and is broadcast so, as most of its bits are 0.

    It takes a byte for 8 bits from the start, whatever the size of the input.
    """
    out = np.zeros(1 << (bits - 3), np.uint8)
    if len(at):
        of = at >> 3
        firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[firsts]] = np.bitwise_or.reduceat(np.right_shift(128, at & 7).astype(np.uint8), firsts)
    return zlib.compress(out, 1)


def bitmap(parts: DataFrame, shares: int) -> list[bytes | None]:
    """The compressed slices of a bitmap given as (share, marks), in their order; None where a share has none.

    A bitmap's size does not grow with the input. The slices are stored first and come to the driver a few at a time.
    """
    whole: list[bytes | None] = [None] * shares
    for share, marks in stored(parts).coalesce(8).toLocalIterator():
        whole[share] = bytes(marks)
    return whole


def unpacked(whole: list[bytes | None], bits: int) -> np.ndarray:
    """The bitmap of 2^bits bits of compressed slices: each task makes its own and drops it at its end."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = len(out) // len(whole)
    for share, marks in enumerate(whole):
        if marks:
            out[share * step : (share + 1) * step] = np.frombuffer(zlib.decompress(marks), np.uint8)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows whose crc32 of the id's text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text of a table: what the number of shares is taken from, so that shares keep their size."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return rows, size or 0


def slices_of(bits: int, size: float) -> int:
    """The exponent of the slices that a bitmap of 2^bits bits is made in: one for each unit of size, and eight at least, as a task holds a slice."""
    return min(bits - 3, max(3, two_to(size)))


def two_to(n: float) -> int:
    """The exponent of the smallest power of two that is at least n; 0 for less than one."""
    return max(0, int(n - 1e-9).bit_length()) if n > 1 else 0
