"""What the operators of this subpackage share: tables in the shared folder, Arrow text buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import ship

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one of our own only where none is
    named and driver and executors are one process, so that its local folder is everybody's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: this cuts the lineage and
    survives the loss of any executor. The table goes when the application ends, or by `forget`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserae_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by `saved` that nothing reads any more."""
    path = getattr(df, "_tesserae_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def written() -> int:
    """How many tables `saved` has made that are still there."""
    return len(_WRITTEN)


def forget_since(count: int, *kept: DataFrame) -> None:
    """Delete the tables made since there were `count`, but for `kept`: a finished stage's own."""
    paths = {getattr(df, "_tesserae_path", None) for df in kept}
    for spark, path in _WRITTEN[count:]:
        if path not in paths:
            _delete(spark, path)
    _WRITTEN[count:] = [x for x in _WRITTEN[count:] if x[1] in paths]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            return


def least_hashed(df: DataFrame, rank: str, count: int, rows: int) -> DataFrame:
    """The rows of `df`, of which there are `rows`, that can be among the `count` of least 64-bit hash
    `rank`: about twice as many. So what is sorted for a sample doesn't grow with the tasks."""
    share = (2 * count + 100) / max(rows, 1)
    return df if share >= 1 else df.where(F.col(rank) < int(-(2**63) + share * 2**64))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries give freed memory back by themselves
    _trim = None


def release() -> None:
    """Give memory that nothing uses any more back to the system: workers outlive their tasks, and
    what one task has freed would count beside the next one's."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable, drop: Callable[[], None] | None = None) -> Callable:
    """An iterator function for mapInArrow that leaves no memory behind in its worker; `drop`
    empties what the worker remembers between rows."""

    @functools.wraps(run)
    def outer(it):
        try:
            yield from run(it)
        finally:
            if drop is not None:
                drop()
            release()

    return outer


def fan(spark: SparkSession) -> int:
    """How many ranges or buckets a hash exchange deals to: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(df: DataFrame) -> int:
    """How many ranges of hashes to deal the contents of `df` to: no fewer than the session's shuffle
    partitions, and so many that one has about 64 MB of the input by Spark's estimate, where it has one
    (a size no input has stands for none)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(fan(df.sparkSession), -(-size // (64 << 20)) if size < 10**15 else 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(raw: np.ndarray, at: np.ndarray, limit: int = 1 << 20):
    """Runs of whole rows of about `limit` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def batches(schema: pa.Schema, columns: dict[str, object], rows: int = 50_000):
    """Record batches of at most `rows` rows."""
    whole = pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)
    yield from whole.to_batches(max_chunksize=rows)
