"""Statistics: ranks, correlations, outliers, weights, regression from moments."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_BUCKETS = 64


def value_places(df: DataFrame, value: str, group: list[str], weight: Column | None = None) -> DataFrame:
    """Of each group's distinct values: `n` rows (or the sum of `weight`) that have it, `below` that
    have a smaller one, `total`, and the `bucket` it is in.

    Distinct values are dealt to buckets by fixed approximate quantiles, numbered inside them, and a
    bucket's start is the sum of the buckets before: no task orders all values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), [k / _BUCKETS for k in range(1, _BUCKETS)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    dealt = counts.withColumn("bucket", bucket)
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = dealt.withColumn("_in", before(Window.partitionBy(*group, "bucket").orderBy(value), "n"))
    sums = dealt.groupBy(*group, "bucket").agg(F.sum("n").alias("_m"))
    starts = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("bucket").alias("_b"), before(Window.partitionBy(*group).orderBy("bucket"), "_m").alias("_start"), F.sum("_m").over(Window.partitionBy(*group)).alias("total"))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], F.col("bucket") == F.col("_b"))
    return inside.join(starts, same).select(*group, value, "n", (F.col("_start") + F.col("_in")).alias("below"), "total", "bucket")


def with_rank(df: DataFrame, value: str, group: list[str], name: str, ascending: bool = True, percent: bool = False) -> DataFrame:
    """Ranks with ties averaged, null for null; over the number of values if `percent`,
    which isn't `percent_rank`."""
    below = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("n")
    rank = below + (F.col("n") + 1) / 2.0
    places = value_places(df, value, group).select(*[F.col(c).alias(f"_{c}") for c in [*group, value]], (rank / F.col("total") if percent else rank).alias(name))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col(value) == F.col(f"_{value}"))
    return df.join(places, same, "left").select(*df.columns, name)


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Over complete pairs; null for fewer than `least` or a constant side."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (spread > 0), F.covar_pop(a, b) / spread)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def correlations(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """The upper triangle in long form, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[pearson(F.col(a), F.col(b), least).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p"))
    return long.select("p.*")


def iqr_flags(df: DataFrame, columns: list[str], width: float = 1.5) -> DataFrame:
    """Fences from exact quartiles, one row of bounds beside all rows, and reasons in order."""
    bounds = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    reasons = []
    for c in columns:
        q1, q3 = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        iqr = q3 - q1
        reasons.append(F.when(F.col(c).isNull(), f"{c}:missing").when(F.col(c) < q1 - width * iqr, f"{c}:low_iqr").when(F.col(c) > q3 + width * iqr, f"{c}:high_iqr"))
    found = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return out.withColumn("anomaly_reasons", F.array_join(found, ",")).withColumn("anomaly_flag_count", F.size(found)).drop(*[f"_{c}" for c in columns])


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """By the population's deviation; null where that is 0."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*df.columns, *[F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}_zscore") for c in columns])


def noise_weights(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """A weight for each group: its variance shrunk to the median one, inverted, clipped to
    the 5th and 95th percentile, and scaled to mean 1."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp(target).alias("var"))
    whole = g.agg(F.coalesce(F.percentile(F.when(F.col("var") != 0, F.col("var")), F.lit(0.5)), F.lit(1.0)).alias("g"))
    s = g.crossJoin(F.broadcast(whole)).withColumn("v", F.coalesce("var", "g"))
    s = s.withColumn("shrunk", F.col("n") / (F.col("n") + 2.0) * F.col("v") + 2.0 / (F.col("n") + 2.0) * F.col("g")).withColumn("raw", 1 / (F.col("shrunk") + 0.05 * F.col("g")))
    clip = s.agg(F.percentile("raw", F.array(F.lit(0.05), F.lit(0.95))).alias("c"))
    s = s.crossJoin(F.broadcast(clip)).withColumn("w", F.least(F.greatest("raw", F.col("c")[0]), F.col("c")[1]))
    mean = s.agg(F.avg("w").alias("mean"))
    return s.crossJoin(F.broadcast(mean)).select(*keys, "n", "shrunk", (F.col("w") / F.col("mean")).alias("weight"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, percent: float = 10.0) -> DataFrame:
    """Mean between two percentiles, inclusive; the plain mean of fewer than five."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(percent / 100), F.lit(1 - percent / 100))).alias("q"), F.count(value).alias("n"), F.avg(value).alias("plain"))
    kept = df.join(q, keys).where((F.col("n") < 5) | F.col(value).between(F.col("q")[0], F.col("q")[1]))
    return kept.groupBy(*keys).agg(F.avg(value).alias("trimmed"))


def least_squares(df: DataFrame, features: list[str], target: str) -> tuple[str, int, list[float]]:
    """Method, rows and coefficients (intercept first) from sums of products, which one
    aggregation gives whatever the number of rows; `mean` under four rows, `none` without any."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    whole = df.dropna(subset=[*features, target])
    moments = [F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]
    r = whole.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), *moments, *[F.sum(a * y).alias(f"y{i}") for i, a in enumerate(x)]).first()
    if not r["n"]:
        return "none", 0, [0.0] * len(x)
    if r["n"] < 4:
        return "mean", r["n"], [r["mean"]] + [0.0] * (len(x) - 1)
    k = len(x)
    a = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return "ols", r["n"], np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(k)]), rcond=None)[0].tolist()


def linear(coefficients: list[float], features: list[str]) -> Column:
    return reduce(lambda s, cf: s + F.lit(cf[0]) * F.col(cf[1]), zip(coefficients[1:], features, strict=True), F.lit(coefficients[0]))


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of correlations by Student's t, from the incomplete beta function."""
    out = np.ones(len(r))
    for i, (c, m) in enumerate(zip(r, n, strict=True)):
        if m > 2 and abs(c) < 1:
            t2 = c * c * (m - 2) / (1 - c * c)
            out[i] = _beta_ratio((m - 2) / 2, 0.5, (m - 2) / (m - 2 + t2))
        elif m > 2:
            out[i] = 0.0
    return out


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_ratio(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-30 else 1e-30)
        c = 1 + num / c if abs(1 + num / c) > 1e-30 else 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """Adjusted p-values: of each value the least of p * n / rank from it upwards, 1 at most.
    The minimum runs inside buckets of distinct values, then over the buckets above."""
    each = value_places(df, p, []).withColumn("_q", F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    inside = each.withColumn("_q", F.min("_q").over(Window.partitionBy("bucket").orderBy(F.desc(p))))
    above = each.groupBy("bucket").agg(F.min("_q").alias("_m")).select(F.col("bucket").alias("_b"), F.min("_m").over(Window.partitionBy().orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))  # a row a bucket
    found = inside.join(above, F.col("bucket") == F.col("_b")).select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.col("_q"), F.col("_above")).alias("q"))
    return df.join(found, F.col(p) == F.col("_p"), "left").select(*df.columns, "q")
