"""Helpers that the text operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    the session names none, a local session (one machine) gets a temporary one,
    and a cluster's is refused: its executors couldn't read a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Deletes tables that stash wrote, once all that is read from them is
    written too: a query of many steps would else fill the shared folder."""
    for df in written:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage, so that Spark's cleaner deletes the
    shuffle files of steps that are done and written. Spark itself does so by the
    clock (spark.cleaner.periodicGC.interval), half an hour by default, which is
    long after a query of many steps has filled the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about `most` bytes of a text column (or
    values of a list column) and `rows` rows at most, or one row; bounds a
    worker's memory whatever the length of the texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held_by = batch.column(column)
        lengths = (pc.list_value_length(held_by) if pa.types.is_list(held_by.type) or pa.types.is_large_list(held_by.type) else pc.binary_length(held_by.cast(pa.large_binary()))).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, without decoding; None where null."""
    return column.cast(pa.large_binary()).to_pylist()


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about `size` bytes, cut between words."""
    if len(data) <= size:
        yield data.split()
        return
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner", row_bytes: Column | int = 64, most: int = 4 << 20) -> DataFrame:
    """Joins a table that is written already (see stash) to a big one. Its bytes
    are summed (row_bytes: of a row, as a number or by its columns), and it is
    broadcast where they are at most `most`; beyond that both sides are
    shuffled."""
    size = small.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return big.join(F.broadcast(small) if size <= most else small, on, how)


MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(4096, np.uint64)
np.multiply.accumulate(np.full(4095, 0x9E3779B97F4A7C15, np.uint64), out=_POWERS[1:])
MULTIPLIERS[SPACE] = 0


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values (MurmurHash3's)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words begin in an array of bytes."""
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    return np.flatnonzero(solid & ~before)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of an array of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    offset = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = MULTIPLIERS[data[starts[0] :]] * _POWERS[offset & 4095]
    return mix64(np.add.reduceat(values, starts - starts[0]))
