"""Helpers shared by the training-data operators.

Text semantics used throughout: a null text is an empty text, only the letters
A-Z are lower-cased, and words are maximal runs of bytes outside the space and
the control characters 0x09 to 0x0D.  ``bytes.lower`` and ``bytes.split`` have
exactly these semantics on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return text_bytes(text).lower().split()


def fold_of(doc_id: int | None, modulus: int) -> int:
    """crc32 of the decimal text of ``doc_id`` modulo ``modulus``; null counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_column(doc_id, modulus: int):
    """Column form of :func:`fold_of`."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one is set only where none is configured and the master is local."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="trivium-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Folders of the tables that the current :func:`scratch` block has written.
_written: ContextVar[list | None] = ContextVar("_written", default=None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`materialise` wrote within it; nothing that is read later may rest on them."""
    token = _written.set([])
    try:
        yield
    finally:
        for folder in _written.get():
            _delete(spark, folder)
        _written.reset(token)


ROWS_A_FILE = 50_000


def materialise(df: DataFrame, name: str, stays: bool = False, rows: int | None = None, least: int | None = None, by: str | None = None, most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and survives the loss of executors: later reads go to the
    shared files, not to blocks held by one executor.  ``stays``: a
    :func:`scratch` block leaves it in place.  ``rows``: about how many there
    are, which keeps a small table from many files; ``least`` files are written
    even so, one a core unless it is given.  ``by``: a column whose values
    become folders, so that a filter on it reads only what it wants.  ``most``:
    rows of a file at most, for rows so large that those of one file would fill
    the memory of the task that writes it, and again of the one that reads it.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(least or spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    folder = f"{shared_folder(spark)}/trivium-{uuid.uuid4().hex}"
    if not stays and _written.get() is not None:
        _written.get().append(folder)
    writer = df.write if by is None else df.write.partitionBy(by)
    (writer if most is None else writer.option("maxRecordsPerFile", most)).parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._trivium_folder = folder
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote and that nothing reads any more."""
    _delete(table.sparkSession, table._trivium_folder)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Have Spark hand texts to Python in batches of about 8 MB, unless the session says otherwise.

    Each running task holds a batch several times, in the JVM and in Python;
    with the default of 64 MB that is most of what a small executor has.
    """
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, str(size))


def _reads_alike(docs: DataFrame) -> bool:
    """Does ``docs`` read files (or cached rows) and nothing else than choose rows and columns of them?"""
    nodes = [docs._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation", "InMemoryRelation"):
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that tells its rows apart, and the name of that column, which ``docs`` does not have.

    The number is the row's partition and place in it, which stay the same
    however often files are read and whichever columns; rows that come from
    anything else are written to the shared folder first.
    """
    small_batches(docs.sparkSession)
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    if not _reads_alike(docs):
        docs = materialise(docs, "rows")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def release_memory() -> None:
    """Give memory that a worker has freed back to the system; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def rows_of(batches, columns, size: int = 512):
    """Rows of Arrow batches as tuples, converted in small parts."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def total_text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, used only to size partitions."""
    row = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def power_of_two_at_least(n: float) -> int:
    p = 1
    while p < n:
        p *= 2
    return p


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def pack_sorted(values: np.ndarray) -> bytes:
    """Byte planes of the differences of ascending uint64 values: general compressors like these."""
    deltas = np.diff(values, prepend=U64(0))
    return np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
