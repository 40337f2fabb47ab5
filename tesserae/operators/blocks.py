"""Stated query sets against all rows, block by block: each task keeps the best of its own rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows of a block
_SMALL = 32 << 20  # bytes for each core under which files alone don't keep all cores busy


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size; the files' sizes where it is a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt to all cores before work that is heavy for its size: one file of one row
    group is one partition otherwise. Large inputs have many files and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * _SMALL else df


def best(values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of `values` the places of the `k` least numbers, ties by id; NaN is none."""
    if not values.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    filled = np.where(np.isnan(values), np.inf, values)
    least = np.partition(filled, min(k, filled.shape[1]) - 1, axis=1)[:, min(k, filled.shape[1]) - 1]
    row, column = np.nonzero((filled <= least[:, None]) & np.isfinite(filled))
    order = np.lexsort((ids[column], filled[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def packed(df: DataFrame, key: str, values: list[str] | str, prefix: str) -> DataFrame:
    """Rows of (ids, matrix), `BLOCK` rows of `df` in each, from number columns (null is NaN) or from
    one array column whose rows are of one length."""
    one = isinstance(values, str)
    columns = F.col(values).cast("array<double>") if one else F.array(*[F.col(c).cast("double") for c in values])
    schema = pa.schema([(f"{prefix}_ids", pa.binary()), (f"{prefix}_matrix", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(rows).tobytes()], pa.binary())], schema=schema)

        for b in it:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                flat = part.column("v").flatten()
                ids.append(np.asarray(part.column("k")))
                rows.append(np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, np.float64))
                held += part.num_rows
                if held >= BLOCK:
                    yield out()
                    ids, rows, held = [], [], 0
        if held:
            yield out()

    return df.select(F.col(key).cast("long").alias("k"), columns.alias("v")).where("k IS NOT NULL AND v IS NOT NULL").mapInArrow(run, f"{prefix}_ids binary, {prefix}_matrix binary")


def nearest(pool: DataFrame, queries: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, width: int | None = None) -> DataFrame:
    """(qid, id, value): candidates for the `k` rows of the pool that `measure` (rows of queries x rows
    of the pool, less is nearer) puts nearest to each query, itself left out: the best of each pair
    of blocks. Both sides are `packed` rows, "q" and "p"; blocks meet, not rows."""
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("value", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                qid, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["p_ids"], np.int64)
                q, p = (np.frombuffer(r[f"{x}_matrix"], np.float64).reshape(len(n), -1) for x, n in (("q", qid), ("p", ids)))
                for lo in range(0, len(qid), 256):
                    values = measure(q[lo : lo + 256], p)
                    values[qid[lo : lo + 256][:, None] == ids[None, :]] = np.nan
                    row, column = best(values, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[lo + row]), pa.array(ids[column]), pa.array(values[row, column])], schema=schema)

    return pool.crossJoin(queries).mapInArrow(run, "qid long, id long, value double")
