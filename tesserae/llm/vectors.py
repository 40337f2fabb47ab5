"""Embedding near-dedup by a subspace pigeonhole join.

Equal vectors of one label are one class first, with their number, so copies are never compared
with each other; links are counted by the numbers of the classes they join. Vectors of one label are
normalised and turned by one fixed random rotation, which spreads their energy evenly, and cut into
`blocks` blocks of few dimensions. Two unit vectors of cosine >= t have squared distance <= 2 - 2t;
so at least one block has at most its proportional share of that budget. Each block is joined by
range: the first two coordinates of a block make a grid whose cells are as wide as the share's
root, so partners are in the same or a neighbouring cell. A vector goes to its own cell and, as a
probe, to half of the neighbouring cells; every pair within budget meets in exactly one cell of a
block. A pair is taken in the first block whose budget it keeps, so the union of the blocks'
candidates holds no pair twice, and its cosine is then computed in double precision from the given
components, which travel in the precision they are given in.

A cell of many vectors or probes is cut into chunks, and chunks are compared pair by pair in
different tasks. No pair leaves its task: each returns numbers of links by vector, and links that
span the components it found.

Defined cases: null labels, null or zero vectors, vectors with null or non-finite components,
and vectors of different lengths link with nothing; equal vectors link; rows that repeat an id
are different vectors whose links count for that id; null ids link with nothing; an empty table
gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import batches, buffers, lean, saved
from tesserae.llm.components import components

_CHUNK = 4096  # vectors of a cell that are compared with each other in one task
_HOME = "label long, dim int, block int, x int, y int"


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(9)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def shares(dim: int, blocks: int, budget: float) -> np.ndarray:
    """Each block's part of the squared distance, in proportion to its dimensions."""
    return budget * np.diff(cuts(dim, blocks)) / dim


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return buffers(column)[0].view(kind).reshape(n, -1).astype(np.float64)


def _clean(kind: type):
    """Usable vectors as binary numbers of the kind they are given in."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])
    wide = np.dtype(kind).itemsize

    def run(it):
        for b in it:
            lists = b.column("embedding")
            at = np.asarray(lists.offsets).astype(np.int64)
            inner = lists.values.slice(at[0], at[-1] - at[0])
            at -= at[0]
            x = np.asarray(inner.fill_null(np.nan) if inner.null_count else inner).astype(kind)
            dim = np.diff(at)
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.add.reduceat(np.append(x.astype(np.float64) ** 2, 0.0), at[:-1]) if len(dim) else np.empty(0)
            good = (dim > 0) & np.isfinite(square) & (square > 0) & np.asarray(lists.is_valid())
            keep = pa.array(good)
            own = x[np.repeat(good, dim)]
            ends = np.concatenate([[0], np.cumsum(dim[good] * wide)]).astype(np.int32)
            vector = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(keep) for k in ("row", "vec_id", "label")), pa.array(dim[good].astype(np.int32)), vector], schema=schema)

    return run


def _cells(cosine: float, blocks: int, kind: type, vectors: bool):
    """Rows for the grids: each vector at home in its cell of each block, and as a probe in half of
    the neighbouring cells; with its `vectors`, or only to be counted."""
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("home", pa.bool_()), ("row", pa.int64())] + [("vec_id", pa.int64()), ("m", pa.int64()), ("vector", pa.binary())] * vectors)
    steps = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]

    def run(it):
        for b in it:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                n = part.num_rows
                v = _matrix(part.column("vector"), n, kind)
                turned = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(dim)
                ends, budget = cuts(dim, blocks), shares(dim, blocks, 2 - 2 * cosine)
                for k in range(len(ends) - 1):
                    wide = np.sqrt(max(budget[k], 1e-12)) * (1 + 1e-6) + 1e-9
                    own = turned[:, ends[k] : ends[k + 1]]
                    x = np.floor(own[:, 0] / wide).astype(np.int32)
                    y = np.floor(own[:, 1] / wide).astype(np.int32) if own.shape[1] > 1 else np.zeros(n, np.int32)
                    for dx, dy in steps:
                        columns = {"label": part.column("label"), "dim": part.column("dim"), "block": np.full(n, k, np.int32), "x": x + np.int32(dx), "y": y + np.int32(dy), "home": np.full(n, (dx, dy) == (0, 0)), "row": part.column("row")}
                        if vectors:
                            columns |= {c: part.column(c) for c in ("vec_id", "m", "vector")}
                        yield from batches(schema, columns)

    return run


def join_up(up: np.ndarray, s: np.ndarray, d: np.ndarray) -> None:
    """Put the trees of `s` and `d` in the forest `up` under their least roots."""
    while len(s):
        for ends in (s, d):
            while True:
                above = up[ends]
                if (above == ends).all():
                    break
                ends[:] = above
        differ = s != d
        s, d = np.minimum(s, d)[differ], np.maximum(s, d)[differ]
        np.minimum.at(up, d, s)


def _links(cosine: float, blocks: int, kind: type):
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        n, dim, block = t.num_rows, t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        home, chunk, row, vec, m = (np.asarray(t.column(k)) for k in ("home", "chunk", "row", "vec_id", "m"))
        v = _matrix(t.column("vector"), n, kind)
        norm = np.linalg.norm(v, axis=1)
        turned = (v / norm[:, None]) @ rotation(dim)
        ends, budget = cuts(dim, blocks), shares(dim, blocks, 2 - 2 * cosine) + 1e-9
        own = turned[:, ends[block] : ends[block + 1]]
        square = (own * own).sum(axis=1)
        left = np.flatnonzero(home & (chunk == i))
        right = np.flatnonzero(~home)
        if j >= 0:
            right = np.flatnonzero(home & (chunk == j)) if i != j else np.concatenate([left, right])
        counts, up = np.zeros(n, np.int64), np.arange(n)
        for lo in range(0, len(left), 256):
            a = left[lo : lo + 256]
            near = square[a][:, None] + square[right][None, :] - 2 * (own[a] @ own[right].T) <= budget[block] + 1e-9
            if i == j:  # home with home once
                near &= np.arange(len(right))[None, :] > np.arange(lo, lo + len(a))[:, None]
            p, q = np.nonzero(near)
            for at in range(0, len(p), 1 << 16):
                s, d = a[p[at : at + (1 << 16)]], right[q[at : at + (1 << 16)]]
                ok = np.einsum("ij,ij->i", v[s], v[d]) / (norm[s] * norm[d]) >= cosine
                s, d = s[ok], d[ok]
                for k in range(block):  # an earlier block that keeps its budget has this pair
                    gap = turned[s, ends[k] : ends[k + 1]] - turned[d, ends[k] : ends[k + 1]]
                    later = (gap * gap).sum(axis=1) > budget[k]
                    s, d = s[later], d[later]
                np.add.at(counts, s, m[d])
                np.add.at(counts, d, m[s])
                join_up(up, s, d)
        some = np.flatnonzero(counts)
        root = some.copy()
        while (up[root] != root).any():
            root = up[root]
        return pa.table({"row": row[some], "vec_id": vec[some], "n": counts[some], "other": vec[root]}, schema=schema)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, blocks: int = 8, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind, listed = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast(listed).alias("embedding"))
    usable = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    clean = saved(usable.mapInArrow(lean(_clean(kind)), "row long, vec_id long, label long, dim int, vector binary").withColumn("same", F.md5("vector")), "vectors")
    # Classes of equal vectors: the least row names one, the least id stands for it.
    equal = ["label", "dim", "same"]
    classes = saved(clean.groupBy(*equal).agg(F.min("row").alias("row"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("m"), F.first("vector").alias("vector")), "classes")
    members = clean.select(F.col("vec_id").alias("id"), *equal).join(classes.select(*equal, "row", "vec_id", "m"), equal).select("id", "row", F.col("vec_id").alias("node"), "m")
    cell = ["label", "dim", "block", "x", "y"]
    held = classes.mapInArrow(lean(_cells(cosine, blocks, kind, False)), f"{_HOME}, home boolean, row long")
    held = held.groupBy(*cell).agg(*(F.ceil(F.count_if(F.col("home") == F.lit(is_home)) / _CHUNK).cast("int").alias(name) for name, is_home in (("chunks", True), ("probes", False))))
    rows = classes.mapInArrow(lean(_cells(cosine, blocks, kind, True)), f"{_HOME}, home boolean, row long, vec_id long, m long, vector binary")
    rows = rows.join(held.where("chunks > 1 OR probes > 1"), cell, "left").select("*", F.pmod(F.xxhash64("row"), F.when(F.col("home"), F.coalesce("chunks", F.lit(1))).otherwise(F.greatest(F.coalesce("probes", F.lit(1)), F.lit(1)))).cast("int").alias("chunk"))
    # Chunks at home meet each other. Probes meet every chunk at home: with the chunk itself where
    # they are few, and chunk by chunk, numbered downwards from -1, where they are many.
    meets = F.expr("""
        CASE WHEN home THEN concat(
                 transform(sequence(0, coalesce(chunks, 1) - 1), k -> named_struct('i', least(chunk, k), 'j', greatest(chunk, k))),
                 CASE WHEN probes > 1 THEN transform(sequence(0, probes - 1), k -> named_struct('i', chunk, 'j', -1 - k)) ELSE array() END)
             WHEN chunks = 0 THEN array()
             ELSE transform(sequence(0, coalesce(chunks, 1) - 1), k -> named_struct('i', k, 'j', CASE WHEN probes > 1 THEN -1 - chunk ELSE k END)) END""")
    dealt = rows.withColumn("meet", F.explode(meets)).select(*cell, "meet.i", "meet.j", "home", "chunk", "row", "vec_id", "m", "vector")
    found = saved(dealt.groupBy(*cell, "i", "j").applyInArrow(_links(cosine, blocks, kind), "row long, vec_id long, n long, other long"), "links")
    # An id of several classes joins them.
    several = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    joined = members.join(several, "id").select(F.col("node").alias("u"), F.col("a").alias("v"))
    label_of = components(found.select(F.col("vec_id").alias("u"), F.col("other").alias("v")).union(joined))
    links = members.join(found.groupBy("row").agg(F.sum("n").alias("n")), "row", "left")
    each = links.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.min("node").alias("node"))
    each = each.join(label_of, "node", "left").select("id", "n_links", F.coalesce("component", "node").alias("component"))
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = ids.join(each, F.col("vec_id") == F.col("id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (
  SELECT vec_id AS p, vec_id AS q FROM embeddings
  UNION SELECT r.p, l.q FROM reach r JOIN link l ON l.p = r.q),
least AS (SELECT p, min(q) AS c FROM reach GROUP BY p),
n AS (SELECT p, count(*) AS n FROM link GROUP BY p)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON least.p = vec_id LEFT JOIN n ON n.p = vec_id
"""
