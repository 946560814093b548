"""Helpers shared by the training-data operators: tables in the shared folder, tokenising, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPOSITORY = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path has it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if REPOSITORY not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([REPOSITORY, *filter(None, paths)])


#: Shuffle files of a finished query are deleted by Spark while this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder; on a cluster executors couldn't read what others write there, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_written: list[str] = []


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    This cuts the lineage: a lost executor re-reads the files instead of recomputing what led to them. So the shuffles of
    this write aren't needed any more after it, and Spark deletes them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """Materialize what ``make`` returns, then delete the tables written on the way to it; the table and its path."""
    before = len(_written)
    table_ = materialize(make(), label)
    for path in _written[before:-1]:
        remove(spark, path)
    path = _written[-1]
    del _written[before:]
    return table_, path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it and as many underscores as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-case A-Z if asked and split at runs of bytes 20, 09-0D: row offsets, a code per token, the distinct words.

    Runs in Arrow's kernels; Python sees each distinct word of the batch once at most.
    """
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")  # a copy: kernels misread slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return before[np.asarray(lists.offsets)], np.asarray(coded.indices).astype(np.int64), coded.dictionary


def hash_words(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that sums of word hashes spread evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the system: idle workers stay, and their memory would too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each slice holds about ``most_bytes`` of ``column`` (one long text may exceed it)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end
        trim()
