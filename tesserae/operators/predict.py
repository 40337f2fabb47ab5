"""Prediction from similar rows, and residual models on top."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import blocks
from tesserae.operators.stats import least_squares, linear


def neighbours(pool: DataFrame, queries: DataFrame, features: list[str], target: str, k: int = 5, pool_id: str = "id", query_id: str = "qid") -> DataFrame:
    """The k nearest rows of the pool with a target for each of a stated set of
    queries, itself left out, by the mean L1 distance, scaled by the pool's deviations, over the
    features both rows have. Blocks of rows meet, and only the best of each pair of blocks leave."""
    spread = pool.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    scales = np.array([max(spread[f] or 0.0, 1e-6) for f in features])

    def distance(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        total, used = np.zeros((len(q), len(p))), np.zeros((len(q), len(p)))
        for n, scale in enumerate(scales):
            gap = np.abs(q[:, n][:, None] - p[:, n][None, :]) / scale
            there = ~np.isnan(gap)
            total[there] += gap[there]
            used += there
        return np.round(np.where(used > 0, total / np.maximum(used, 1), np.nan), 9)

    usable = pool.where(F.col(target).isNotNull())
    found = blocks.nearest(blocks.packed(usable, pool_id, features, "p"), blocks.packed(queries, query_id, features, "q"), distance, k)
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("value", "id"))).where(F.col("rank") <= k)
    near = near.select(F.col("qid").alias(query_id), F.col("id").alias(pool_id), F.col("value").alias("d"), "rank")
    return near.join(usable.select(pool_id, F.col(target).alias("y")), pool_id)


def inverse_distance(near: DataFrame, query_id: str = "qid") -> DataFrame:
    """Mean of the targets weighted by 1/distance."""
    w = 1 / F.greatest("d", F.lit(1e-6))
    return near.groupBy(query_id).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("baseline"), F.count(F.lit(1)).alias("n"))


SAMPLE = 2048  # rows of the pool that place the edges between which weights are counted
_EDGES = 32


def _kernel(q: np.ndarray, p: np.ndarray, scales: list[float]) -> np.ndarray:
    """Products of exp(-distance/scale) by Arrow's exp, which is the C library's as SQL's is: NumPy's
    and Java's differ in the last bit, and so in which of two almost equal weights is the greater."""
    out = None
    for n, scale in enumerate(scales):
        far = -np.abs(q[:, n][:, None] - p[:, n][None, :]) / scale
        w = pc.exp(pa.array(far.ravel())).to_numpy(zero_copy_only=False).reshape(far.shape)
        out = w if out is None else out * w
    return out


def _edges(q: np.ndarray, sample: np.ndarray, scales: list[float], share: float) -> np.ndarray:
    """Of each query the weights in a sample around the quantile, five deviations of its rank either way."""
    w = np.nan_to_num(_kernel(q, sample, scales))
    size = w.shape[1]
    ranks = share * size + np.linspace(-5, 5, _EDGES) * np.sqrt(share * (1 - share) * size)
    at = np.clip(np.round(ranks).astype(int), 0, size - 1)
    return np.partition(w, np.unique(at), axis=1)[:, at]


def _interpolated(low: float, high: float, part: float) -> float:
    """The number between two neighbours as SQL rounds it: low * (1 - part) + (high * part) at once."""
    return low if low == high else float(Fraction(low) * Fraction(1 - part) + Fraction(high * part))


def kernel_summary(pool: DataFrame, queries: DataFrame, features: list[str], target: str, scales: list[float], share: float = 0.75, pool_id: str = "id", query_id: str = "qid") -> DataFrame:
    """For each of a stated set of queries the means of the pool's targets (`m`) and of their
    squares (`m2`) weighted by similarity, the greatest weight (`top`) and the number of weights above
    their `share` quantile (`support`).

    The quantile is exact, in two rounds over blocks: the first counts weights between edges that a
    sample of the pool places, the second takes the distinct weights out of the bin that the quantile is
    in, whichever it is. Rows of one query id make one query, with the edges of the least of them."""
    names = [*features, target]
    kept = pool.where(F.col(features[0]).isNotNull()).select(pool_id, *features)
    drawn = kept.orderBy(F.xxhash64(F.col(pool_id)), pool_id).limit(SAMPLE).select(*[F.col(f).cast("double") for f in features]).collect()
    sample = np.array([[np.nan if v is None else v for v in r] for r in drawn], np.float64).reshape(len(drawn), len(features))
    width, bins = len(features), _EDGES + 1
    counts = [f"c{i}" for i in range(bins)]
    sums = ["n", "known", "w", "wy", "wyy"]
    schema = pa.schema([("qid", pa.int64()), *((c, pa.float64()) for c in (*sums, "top", *counts))])
    told = ["first", "last", "below", "above", "n", "m", "m2", "top"]

    def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(r["q_ids"], np.int64)
        q = np.frombuffer(r["q_matrix"], np.float64).reshape(len(ids), -1)
        return ids, q, np.frombuffer(r["p_matrix"], np.float64).reshape(-1, width + 1)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for ids, _, total in held.values():
                columns = [pa.array(total[:, i], mask=np.isnan(total[:, i])) for i in range(total.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *columns], schema=schema)
            held.clear()

        for b in it:
            for r in b.to_pylist():
                ids, q, p = unpacked(r)
                key = (r["q_ids"], r["q_matrix"])
                if key not in held:
                    if len(held) == 16:
                        yield from out()
                    edges = np.concatenate([_edges(q[lo : lo + 256, width : 2 * width], sample, scales, share) for lo in range(0, len(q), 256)])
                    total = np.zeros((len(q), len(sums) + 1 + bins))
                    total[:, len(sums)] = np.nan
                    held[key] = (ids, edges, total)
                _, edges, total = held[key]
                y = p[:, width]
                known = ~np.isnan(y)
                y = np.where(known, y, 0.0)
                for lo in range(0, len(q), 256):
                    w = _kernel(q[lo : lo + 256], p, scales)
                    there = ~np.isnan(w)
                    zero = np.where(there, w, 0.0)
                    t = total[lo : lo + 256]
                    t[:, 0] += there.sum(1)
                    t[:, 1] += (there & known).sum(1)
                    t[:, 2:5] += zero @ np.stack([np.ones(len(y)), y, y * y], axis=1)
                    t[:, 5] = np.fmax(t[:, 5], np.where(there, w, -np.inf).max(1))
                    t[:, 5] = np.where(np.isinf(t[:, 5]), np.nan, t[:, 5])
                    for i, e in enumerate(edges[lo : lo + 256]):
                        over = w[i][w[i] >= e[0]]
                        t[i, 6:] += np.bincount(np.searchsorted(e, over, "right"), minlength=bins)
                        t[i, 6] += there[i].sum() - len(over)
        yield from out()

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bins of the two weights that the quantile is between, and what is on either side."""
        for b in it:
            n = np.asarray(b.column("n"))
            upto = np.cumsum([np.asarray(b.column(c)) for c in counts], axis=0)
            rank = np.maximum(n - 1, 0) * share
            first, last = ((upto <= np.minimum(r, n - 1)[None, :]).sum(0) for r in (np.floor(rank), np.ceil(rank)))
            first, last = np.minimum(first, bins - 1), np.minimum(last, bins - 1)
            at = np.arange(len(n))
            below = np.where(first > 0, upto[np.maximum(first - 1, 0), at], 0.0)
            yield pa.RecordBatch.from_arrays([b.column("qid"), *(pa.array(v.astype(np.float64)) for v in (first, last, below, n - upto[last, at], n)), *(b.column(c) for c in ("m", "m2", "top"))], names=["key", *told])

    def taken(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict[tuple[bytes, bytes], np.ndarray] = {}
        for b in it:
            for r in b.to_pylist():
                ids, q, p = unpacked(r)
                key = (r["q_ids"], r["q_matrix"])
                if key not in edges:
                    if len(edges) == 16:
                        edges.clear()
                    e = np.concatenate([_edges(q[lo : lo + 256, width : 2 * width], sample, scales, share) for lo in range(0, len(q), 256)])
                    e = np.concatenate([np.full((len(q), 1), -np.inf), e, np.full((len(q), 1), np.inf)], axis=1)
                    at = np.arange(len(q))
                    edges[key] = np.stack([e[at, q[:, 2 * width].astype(int)], e[at, q[:, 2 * width + 1].astype(int) + 1]], axis=1)
                for lo in range(0, len(q), 256):
                    w, e = _kernel(q[lo : lo + 256], p, scales), edges[key][lo : lo + 256]
                    row, column = np.nonzero((w >= e[:, :1]) & (w < e[:, 1:]))
                    v = w[row, column]
                    order = np.lexsort((v, row))
                    row, v = row[order], v[order]
                    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (v[1:] != v[:-1])]) if len(v) else np.empty(0, int)
                    times = np.diff(np.r_[start, len(v)])
                    offsets = np.searchsorted(row[start], np.arange(len(w) + 1)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (v[start], times.astype(np.int64))]
                    info = [pa.array(c, mask=np.isnan(c)) for c in q[lo : lo + 256, 2 * width + 2 :].T]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 256]), *info, *lists], names=["qid", *told[2:], "v", "times"])

    def finished(t: pa.Table) -> pa.Table:
        one = {c: t.column(c)[0].as_py() for c in ("qid", *told[2:])}
        v, times = (np.asarray(pc.list_flatten(t.column(c))) for c in ("v", "times"))
        support = 0
        if one["n"]:
            order = np.argsort(v)
            v, upto = v[order], np.cumsum(times[order])
            if int(upto[-1]) != int(one["n"] - one["below"] - one["above"]):
                raise ValueError("rounds differ in their weights")
            rank = (one["n"] - 1) * share
            low, high = (float(v[np.searchsorted(upto, r - one["below"], "right")]) for r in (np.floor(rank), np.ceil(rank)))
            support = int(one["above"]) + int(times[order][v > _interpolated(low, high, rank - np.floor(rank))].sum())
        return pa.table({query_id: pa.array([one["qid"]], pa.int64()), **{c: pa.array([one[c]], pa.float64()) for c in ("m", "m2", "top")}, "support": pa.array([support], pa.int64())})

    least = F.min(F.struct(*features)).over(Window.partitionBy(query_id))
    asked = queries.where(F.col(query_id).isNotNull()).select(query_id, *features, least.alias("_least"))
    anchors = [f"_least.{f}" for f in features]
    blocks_of = blocks.packed(pool.withColumn("_key", F.lit(0)), "_key", names, "p")
    first = blocks_of.crossJoin(blocks.packed(asked, query_id, [*features, *anchors], "q"))
    first = first.mapInArrow(counted, "qid long, " + ", ".join(f"{c} double" for c in (*sums, "top", *counts)))
    first = first.groupBy("qid").agg(*[F.sum(c).alias(c) for c in (*sums, *counts)], F.max("top").alias("top"))
    ratio = lambda c: F.when(F.col("known") > 0, F.try_divide(F.col(c), F.col("w")))
    first = first.select("qid", "n", *counts, ratio("wy").alias("m"), ratio("wyy").alias("m2"), "top")
    placing = first.mapInArrow(placed, "key long, " + ", ".join(f"{c} double" for c in told))
    again = blocks.packed(asked.join(placing, F.col(query_id) == F.col("key")), query_id, [*features, *anchors, *told], "q")
    second = blocks_of.crossJoin(again).mapInArrow(taken, "qid long, " + ", ".join(f"{c} double" for c in told[2:]) + ", v array<double>, times array<long>")
    return second.groupBy("qid").applyInArrow(finished, f"{query_id} long, m double, m2 double, top double, support long")


def folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Whole groups to folds by a hash of the group."""
    return df.withColumn("fold", F.pmod(F.crc32(F.col(group).cast("string").cast("binary")), F.lit(k)))


def _class_sums(rows: DataFrame, features: list[str], target: str, scales: list[float], k: int) -> DataFrame:
    """Of each distinct vector of features, for each fold g: n{g} and s{g}, the rows that have it and the sum of
    their targets; w{g} and wy{g}, the sums of similarity weights, and of weighted targets, over the
    rows that have others. Rows of one vector weigh alike, so blocks of vectors meet, not of rows."""
    of = lambda x: [f"{x}{g}" for g in range(k)]
    own, sums = [*features, *of("n"), *of("s")], [*of("w"), *of("wy")]
    schema = pa.schema([(c, pa.float64()) for c in (*own, *sums)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                q, p = (np.frombuffer(r[f"{x}_matrix"], np.float64).reshape(-1, len(own)) for x in "qp")
                for lo in range(0, len(q), 256):
                    part = q[lo : lo + 256]
                    gaps = [np.abs(part[:, n][:, None] - p[:, n][None, :]) for n in range(len(scales))]
                    weight = np.exp(-sum(g / s for g, s in zip(gaps, scales, strict=True)))
                    weight[np.logical_and.reduce([g == 0 for g in gaps])] = 0.0
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate([part, weight @ p[:, len(features) :]], axis=1).T], schema=schema)

    at = lambda g: F.col("fold") == g
    counted = [F.count_if(at(g)).alias(f"n{g}") for g in range(k)]
    summed = [F.coalesce(F.sum(F.when(at(g), F.col(target).cast("double"))), F.lit(0.0)).alias(f"s{g}") for g in range(k)]
    classes = rows.groupBy(*features).agg(*counted, *summed).withColumn("_key", F.lit(0))
    pairs = blocks.packed(classes, "_key", own, "p").crossJoin(blocks.packed(classes, "_key", own, "q"))
    met = pairs.mapInArrow(run, ", ".join(f"{c} double" for c in (*own, *sums)))
    return met.groupBy(*features).agg(*[F.max(c).alias(c) for c in own[len(features) :]], *[F.sum(c).alias(c) for c in sums])


def residual_cv(rows: DataFrame, features: list[str], target: str, scales: list[float], k: int) -> DataFrame:
    """U16: out-of-fold predictions as a baseline plus a model of what it leaves.

    The baseline of a row is the mean of the other rows' targets weighted by similarity (F24), over
    the folds it isn't tested in alone: a test row's over the training folds, and, to train the model, a
    training row's over the training folds without itself. So nothing of a fold reaches its own
    predictions. `rows` have id, fold (0 to k - 1), features and target; without id, fold or a feature they
    are left out, and so are those with no others to learn from. Rows alike in all are one, and rows
    of one id are not others to each other."""
    vectors = [f"_v{n}" for n in range(len(features))]
    whole = rows.dropna(subset=["id", "fold", *features]).withColumns({v: F.col(f).cast("double") for v, f in zip(vectors, features, strict=True)})
    same = F.collect_list(F.struct(*[c for c in whole.columns if c != "id"]))
    each = whole.groupBy("id").agg(same.alias("_same")).select("id", "_same", F.explode(F.array_distinct("_same")).alias("_row")).select("id", "_same", "_row.*")
    known = each.join(_class_sums(whole, vectors, target, scales, k), vectors, "left")
    value = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))

    def others(g: int) -> tuple[Column, Column]:
        """The weights, and the weighted targets, of the rows of fold g that have another id."""
        alike = lambda x: reduce(lambda a, v: a & (x[v] == F.col(v)), vectors, F.lit(True))
        weight = lambda x: F.exp(-reduce(lambda a, v: a + F.abs(x[v[0]] - F.col(v[0])) / v[1], zip(vectors, scales, strict=True), F.lit(0.0)))
        total = lambda wanted, f: F.aggregate(F.filter("_same", lambda x: (x["fold"] == g) & wanted(x)), F.lit(0.0), lambda a, x: a + f(x))

        def less(one: Column, near, far) -> tuple[Column, Column]:
            alone = F.size("_same") == 1
            return F.when(alone, F.when(F.col("fold") == g, one).otherwise(0.0)).otherwise(total(alike, near)), F.when(alone, 0.0).otherwise(total(lambda x: ~alike(x), far))

        n, w = less(F.lit(1.0), lambda x: F.lit(1.0), weight)
        s, wy = less(value(F.col(target)), lambda x: value(x[target]), lambda x: weight(x) * value(x[target]))
        return F.col(f"w{g}") - w + (F.col(f"n{g}") - n), F.col(f"wy{g}") - wy + (F.col(f"s{g}") - s)

    sums = [others(g) for g in range(k)]
    known = known.select("id", *[c for c in whole.columns if c != "id"], *[c.alias(f"_{x}{g}") for g in range(k) for x, c in zip(("w", "wy"), sums[g], strict=True)])

    def baseline(fold: int) -> Column:
        total = lambda x: reduce(lambda a, g: a + F.col(f"_{x}{g}"), [g for g in range(k) if g != fold], F.lit(0.0))
        return F.when(total("w") > 0, total("wy") / total("w"))

    tested = predicted = F.lit(None).cast("double")
    for fold in range(k):
        train = known.where(F.col("fold") != fold).withColumn("_left", F.col(target) - baseline(fold))
        _, _, c = least_squares(train, features, "_left")
        at = F.col("fold") == fold
        tested, predicted = F.when(at, baseline(fold)).otherwise(tested), F.when(at, baseline(fold) + linear(c, features)).otherwise(predicted)
    return known.select(*rows.columns, tested.alias("baseline"), predicted.alias("prediction")).where(F.col("baseline").isNotNull())


def cross_validated(df: DataFrame, features: list[str], target: str, make, k: int = 5, weight: str | None = None) -> DataFrame:
    """Out-of-fold predictions; a model for a fold never sees its groups.
    `make()` gives an estimator on a `features` vector and a `label`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    rows = df.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    rows = rows.select("*", *[F.col(f).cast("double").alias(f"f_{f}") for f in features])
    out = None
    for fold in range(k):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        names = [f"f_{f}" for f in features]
        steps = [Imputer(strategy="median", inputCols=names, outputCols=[f"i_{n}" for n in names]), VectorAssembler(inputCols=[f"i_{n}" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), make()]
        if weight:
            steps[-1].setWeightCol(weight)
        told = Pipeline(stages=steps).fit(train).transform(test).select(*df.columns, "label", "prediction")
        out = told if out is None else out.unionByName(told)
    return out


def errors(told: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 of out-of-fold predictions in one aggregation."""
    e = F.col("label") - F.col("prediction")
    return told.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2"))
