"""Small helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: `[\x20\x09-\x0D]`, the bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps, as numpy's unsigned integers do."""
    x = x.astype(np.uint64) + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(256))


def slices(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least: bounds what a task holds."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > most:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def joined(texts: list[bytes], glue: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, `glue` after each, and where each begins (one more: the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(glue) for t in texts], out=at[1:])
    return np.frombuffer(glue.join([*texts, b""]), np.uint8), at


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, both: bool = False):
    """A 64-bit hash of the bytes of each span: the sum of byte codes times a code of the byte's place; both: with a second, independent one."""
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 if both else np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    bytes_ = data if len(place) == len(data) else data[np.repeat(starts, sizes) + place]
    codes = _BYTE[bytes_]
    n, places = sizes.astype(np.uint64), np.arange(int(sizes.max()))
    h = mix64(np.add.reduceat(codes * (mix64(places + 0x5DEECE66) | np.uint64(1))[place], first) + n)
    return (h, mix64(np.add.reduceat(codes * (mix64(places + 0x7F4A7C15) | np.uint64(1))[place], first) ^ n)) if both else h


def words_of(texts: list[bytes], lower: bool = False):
    """(bytes, starts, ends, row of each word, word bounds of each row) of the words `[^\\x20\\x09-\\x0D]+`."""
    data, at = joined(texts, b"\n")
    starts, ends = runs(~SPACE[data])
    if lower:
        data = LOWER[data]
    bounds = np.searchsorted(starts, at)
    return data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set a local session (tests) takes a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def durable_at(df: DataFrame) -> tuple[DataFrame, str]:
    """durable(), and the folder of the table, for forget()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table of durable_at() that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Written as a table to the shared folder and read from there: lost executors cost no recomputation, what was dealt out
    stays as it was, and Spark knows the table's size."""
    return durable_at(df)[0]
