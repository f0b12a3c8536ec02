"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SIZE, _BATCH_ROWS, _BATCH_BYTES = "4m", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN: dict[str, str] = {}
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset in one process (tests), a fresh one; on a cluster, an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: str = BATCH_SIZE):
    """Arrow batches of at most ``rows`` rows that end beyond ``size`` bytes, for jobs that run inside: bounds the memory of executors and their Python workers on wide rows."""
    before = {key: spark.conf.get(key) for key in (_BATCH_ROWS, _BATCH_BYTES)}
    spark.conf.set(_BATCH_ROWS, str(rows))
    spark.conf.set(_BATCH_BYTES, size)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def discard_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these, once nothing reads it any more."""
    for df in tables:
        discard_path(df.sparkSession, _WRITTEN.pop(id(df))[1])


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which a text or binary column has about ``limit`` bytes: what a task holds as Python objects at a time."""
    groups = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def tidy(run):
    """A task's function that gives freed memory back to the system at its end: workers stay for the next stage, and should hold little till then."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def map_rows(rows: DataFrame, run, schema) -> DataFrame:
    """mapInArrow by place: it can't read column names with a dot."""
    return rows.toDF(*(f"_{k}" for k in range(len(rows.columns)))).mapInArrow(tidy(run), schema)


class Cache(dict):
    """What is known of a string, bounded in bytes: a full cache keeps only what is asked for next."""

    def __init__(self, limit: int = 40 << 20):
        super().__init__()
        self.limit, self.held = limit, 0

    def missing(self, some) -> list[str]:
        """What of ``some`` is not here; all of ``some`` can be added then."""
        if self.held > self.limit:
            kept = {w: self[w] for w in some if w in self}
            self.clear()
            self.held = 0
            self.add(kept, kept.values())
        return [w for w in some if w not in self]

    def add(self, strings, values) -> None:
        before = len(self)
        self.update(zip(strings, values, strict=True))
        self.held += 200 * (len(self) - before) + sum(map(len, strings)) + sum(map(len, values))


def bit_filter(rows: DataFrame, key: Column, most: int = 1 << 26) -> np.ndarray:
    """A filter of 64-bit keys, at most ``most`` bits (8 MB) at any number of rows: beyond that it lets more through, never less."""
    size = 1 << 12
    while size < min(most, 16 * rows.count()):
        size *= 2
    at = key.bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    got = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def within(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys (unsigned) pass a ``bit_filter``."""
    at = key & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for reads and writes inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file into place. A second attempt of a task replaces it with equal bytes."""
    fs.move(temporary, final)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, mod n; NULL ids give NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unit_draw(rows: DataFrame, seed: int) -> Column:
    """A draw in [0, 1) by a hash of the text and, where there is one, the id: copies are drawn one by one."""
    keys = [c for c in ("doc_id", "text") if c in rows.columns]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))
