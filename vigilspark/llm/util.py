"""Helpers shared by the operators: the shared folder, Arrow text access, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Whitespace that separates words: space and the ASCII controls tab to carriage return.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one vectorised step takes at once; a longer text makes a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full address: spark.checkpoint.dir as Spark's own file system
    resolves it (a path without a scheme is on the default file system). Where it is unset, a local master takes a
    temporary folder; on a cluster that would be some machine's own, so there it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="vigilspark-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return qualified(spark, folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's full address, as Spark's file systems resolve it."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one whose contents nothing reads any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def arrow_folder(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path by which a task's Python reads and writes a full address from `fresh_path`."""
    scheme, _, rest = address.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):  # Hadoop's names for what Arrow calls s3
        address = "s3:" + rest
    return pafs.FileSystem.from_uri(address)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to the shared folder once, and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when it ends, and don't stay on the executors' disks until the driver happens
    to collect its garbage. For operators of many queries whose results are written or checkpointed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = f"_{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and len+1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES):
    """Slices a batch so that each slice holds about `most` bytes of text, whole rows always."""
    _, offsets = text_bytes(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end
