"""Image operators over rows: polylines by windows, masks dealt out to tasks by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry as Y

# Limits of curvature in 1/nm between straight, wavy and coiled.
STRAIGHT, WAVY = 8e-4, 4e-3


def px_per_um(width: Column, magnification: Column) -> Column:
    """Pixels per micrometre of an image 518000/magnification micrometres wide."""
    return width / (F.lit(518000.0) / magnification)


def point_curvature(points: DataFrame, branch: str, order: str) -> DataFrame:
    """Menger curvature at each inner point of an ordered polyline (y, x), by neighbours."""
    w = Window.partitionBy(branch).orderBy(order)
    p = points.select(branch, order, "y", "x", *[f(c).over(w).alias(f"{k}{c}") for c in ("y", "x") for k, f in (("p", F.lag), ("n", F.lead))])
    d = lambda a, b: F.sqrt((F.col(f"{a}y") - F.col(f"{b}y")) ** 2 + (F.col(f"{a}x") - F.col(f"{b}x")) ** 2)
    cross = F.abs((F.col("y") - F.col("py")) * (F.col("nx") - F.col("x")) - (F.col("x") - F.col("px")) * (F.col("ny") - F.col("y")))
    p = p.select(branch, order, d("", "p").alias("a"), d("n", "").alias("b"), d("n", "p").alias("c"), cross.alias("cross"))
    return p.where(F.least("a", "b", "c") > 1e-6).select(branch, order, (2 * F.col("cross") / (F.col("a") * F.col("b") * F.col("c"))).alias("k"))


def arc_length(points: DataFrame, branch: str, order: str) -> DataFrame:
    """Length along a polyline up to each point."""
    w = Window.partitionBy(branch).orderBy(order)
    step = F.sqrt((F.col("y") - F.lag("y").over(w)) ** 2 + (F.col("x") - F.lag("x").over(w)) ** 2)
    return points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def branch_curvatures(points: DataFrame, image: str, branch: str, order: str, per_nm: float = 1.0) -> DataFrame:
    """Of each branch its length and the median, upper quartile and mean of its points' curvature."""
    key = points.select(image, branch).distinct()
    k = point_curvature(points, branch, order).groupBy(branch).agg(F.percentile(F.col("k") * per_nm, F.array(F.lit(0.5), F.lit(0.75))).alias("q"), F.avg(F.col("k") * per_nm).alias("mean"))
    length = arc_length(points, branch, order).groupBy(branch).agg(F.max("arc").alias("length"))
    return key.join(k, branch).join(length, branch).select(image, branch, "length", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p75"))


def bundled(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Branch curvatures of each key weighted by length and its root; 0 where there are none."""
    aggs = []
    for s in ("p50", "p75", "mean"):
        for tag, w in (("length", F.greatest("length", F.lit(1.0))), ("sqrt_length", F.sqrt(F.greatest("length", F.lit(1.0))))):
            good = F.when(F.col(s) > 0, w)
            aggs.append(F.coalesce(F.sum(F.col(s) * good) / F.sum(good), F.lit(0.0)).alias(f"{s}_{tag}"))
    return branches.groupBy(*keys).agg(*aggs, F.count("length").alias("branches"))


def curvature_bundle(points: DataFrame, image: str, branch: str, order: str, per_nm: float = 1.0) -> DataFrame:
    """Curvatures of each image's branches."""
    return bundled(branch_curvatures(points, image, branch, order, per_nm), [image])


def branch_profiles(points: DataFrame, image: str, branch: str, order: str, factors: list[float], tube_px: float) -> DataFrame:
    """The bundle of each image at each of a few length factors, over branches at least so many
    tube widths long; one row an image and factor, also where no branch is long enough."""
    branches = branch_curvatures(points, image, branch, order)
    each = branches.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    long = F.col("length") >= F.col("factor") * tube_px
    kept = each.select(image, "factor", *[F.when(long, F.col(c)).alias(c) for c in ("length", "mean", "p50", "p75")])
    return bundled(kept, [image, "factor"])


def regions(pixels: DataFrame, image: str) -> DataFrame:
    """Rows of each image above its information bar, from its pixel rows (image, y, x, v)."""
    return pixels.groupBy(image).applyInArrow(_of_image(image, lambda m: float(len(Y.roi(m)))), f"{image} long, value double").select(image, F.col("value").cast("long").alias("rows"))


def foregrounds(pixels: DataFrame, image: str) -> DataFrame:
    """Pixels of each image above their surroundings, after its contrast is equalised."""
    return pixels.groupBy(image).applyInArrow(_of_image(image, lambda m: float(Y.adaptive_threshold(Y.equalised(m)).sum())), f"{image} long, value double").select(image, F.col("value").cast("long").alias("foreground"))


def _of_image(image: str, figure):
    def run(t: pa.Table) -> pa.Table:
        y, x, v = (np.asarray(t.column(c)).astype(int) for c in ("y", "x", "v"))
        m = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        m[y, x] = v
        return pa.table({image: pa.array([t.column(image)[0].as_py()], pa.int64()), "value": pa.array([figure(m)], pa.float64())})

    return run


def curvature_label(value: Column) -> Column:
    return F.when(value < STRAIGHT, "Straight").when(value < WAVY, "Wavy").otherwise("Coiled")


def profiles(points: DataFrame, branch: str) -> DataFrame:
    """Each branch of 20 points or more seen along its principal axis: mean places (s) and
    heights (level) of columns one pixel wide, less their straight line, smoothed over five columns."""
    axis = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    one = Window.partitionBy(branch)
    whole = lambda *order: one.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # noqa: E731  # sums in one order
    shape = {"n": F.count(F.lit(1)), "mx": F.avg("x"), "my": F.avg("y"), "xx": F.var_pop("x"), "yy": F.var_pop("y"), "xy": F.covar_pop("x", "y")}
    known = points.where(F.col(branch).isNotNull()).select(branch, "y", "x", *[f.over(whole("x", "y")).alias(c) for c, f in shape.items()])
    turned = known.where("n >= 20").select(branch, "y", "x", "mx", "my", axis.alias("a"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    seen = turned.select(branch, (dx * F.cos("a") + dy * F.sin("a")).alias("s"), (dy * F.cos("a") - dx * F.sin("a")).alias("d"))
    columns = seen.withColumn("c", F.round(F.col("s") - F.min("s").over(one)).cast("int")).groupBy(branch, "c").agg(F.avg("s").alias("s"), F.avg("d").alias("d"))
    flat = columns.select(branch, "c", "s", (F.col("d") - F.regr_intercept("d", "s").over(whole("c")) - F.regr_slope("d", "s").over(whole("c")) * F.col("s")).alias("r"), F.count(F.lit(1)).over(whole("c")).alias("m"))
    return flat.where("m >= 12").select(branch, "c", "s", (F.sum("r").over(one.orderBy("c").rowsBetween(-2, 2)) / 5).alias("level"))


def turns(profile: DataFrame, branch: str, spacing: float) -> DataFrame:
    """Of each branch its peaks (kind 1) and troughs (-1) in order, `spacing` apart and by turns:
    of rivals the more extreme stays. `arc` and `span` are the profile's length and its ends' distance."""
    w = Window.partitionBy(branch).orderBy("c")
    rise, fall = F.col("level") - F.lag("level").over(w), F.lead("level").over(w) - F.col("level")
    kind = F.when((rise >= 0) & (fall < 0), 1).when((rise <= 0) & (fall > 0), -1)
    step = F.hypot(F.col("s") - F.lag("s").over(w), rise)
    told = profile.select(branch, "c", "s", "level", kind.alias("kind"), step.alias("step"))
    found = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("s", F.col("level").alias("v"), "kind"))))
    ends = F.hypot(F.max_by("s", "c") - F.min_by("s", "c"), F.max_by("level", "c") - F.min_by("level", "c"))
    each = told.groupBy(branch).agg(found.alias("found"), F.sum("step").alias("arc"), ends.alias("span"), (F.max("level") - F.min("level")).alias("range"))
    kept = F.aggregate(
        "found",
        F.slice("found", 1, 0),
        lambda out, now: F.when(F.size(out) == 0, F.array(now)).otherwise(
            F.when((now["kind"] != F.element_at(out, -1)["kind"]) & (now["s"] - F.element_at(out, -1)["s"] >= spacing), F.concat(out, F.array(now)))
            .when(now["kind"] * now["v"] > now["kind"] * F.element_at(out, -1)["v"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(now)))
            .otherwise(out)
        ),
    )
    return each.where("range >= 2").select(branch, F.when(F.size("found") > 0, kept).otherwise(F.col("found")).alias("turns"), "arc", "span")


def wave_rows(points: DataFrame, branch: str, tube_px: float = 4.0) -> DataFrame:
    """One row for each branch that has waves: height over wavelength, height and wavelength,
    weighted by wavelength, from a turn of one kind to the next of it, and the profile's tortuosity."""
    spacing = max(3.0, 2 * tube_px)
    t = turns(profiles(points, branch), branch, spacing)
    three = lambda i: (F.element_at("turns", i), F.element_at("turns", i + 1), F.element_at("turns", i + 2))

    def wave(i: Column) -> Column:
        a, b, c = three(i)
        whole = (a["kind"] == c["kind"]) & (a["kind"] != b["kind"]) & (c["s"] - a["s"] > 1.5 * spacing)
        return F.when(whole, F.struct(((F.abs(b["v"] - a["v"]) + F.abs(b["v"] - c["v"])) / 2).alias("h"), (c["s"] - a["s"]).alias("l")))

    waves = F.filter(F.transform(F.sequence(F.lit(1), F.size("turns") - 2), wave), lambda x: x.isNotNull())
    held = t.where(F.size("turns") >= 3).select(branch, "arc", "span", waves.alias("waves")).where(F.size("waves") > 0)
    total = lambda f: F.aggregate("waves", F.lit(0.0), lambda s, x: s + f(x))
    length = total(lambda x: x["l"])
    return held.select(
        branch, (total(lambda x: x["h"]) / length).alias("ratio"), (total(lambda x: x["h"] * x["l"]) / length).alias("height_px"), (total(lambda x: x["l"] * x["l"]) / length).alias("wavelength_px"),
        F.when(F.col("span") > 0, F.greatest(F.lit(1.0), F.col("arc") / F.col("span"))).otherwise(1.0).alias("tortuosity"),
    )


def mask_rows(pixels: DataFrame, image: str) -> DataFrame:
    """Figures of each image from its pixel rows (image, y, x, v)."""
    names = ["density", "junctions", "ends", "skeleton", "components", "longest", "orientation", "angle", "orientation_across", "coherence", "diameter", "edges", "best_path"]
    schema = pa.schema([(image, pa.int64()), *((n, pa.float64()) for n in names), ("rose", pa.list_(pa.float64()))])

    def run(t: pa.Table) -> pa.Table:
        y, x, v = (np.asarray(t.column(c)).astype(int) for c in ("y", "x", "v"))
        m = np.zeros((int(y.max()) + 1, int(x.max()) + 1), int)
        m[y, x] = v
        parts = Y.components(m)
        j, e, n = Y.junctions(m)
        hof, angle, _ = Y.orientation(parts)
        edges = Y.branch_graph(m)
        paths = Y.best_paths(edges)
        width = Y.diameter(Y.widths(m, m), 0.0)
        row = [float((m > 0).mean() * 100), j, e, n, len(parts), len(Y.ordered(parts[0])) if parts else 0, hof, angle, Y.orientation(parts, True)[0], Y.structure_tensor(m * 255.0)[1], width, len(edges), paths[0][0] if paths else 0.0]
        return pa.table([pa.array([t.column(image)[0].as_py()], pa.int64()), *(pa.array([None if a is None else float(a)], pa.float64()) for a in row), pa.array([Y.rose(m * 255.0).tolist()], pa.list_(pa.float64()))], schema=schema)

    return pixels.select(image, "y", "x", "v").groupBy(image).applyInArrow(run, f"{image} long, " + ", ".join(f"{n} double" for n in names) + ", rose array<double>")


def junction_counts(pixels: DataFrame, image: str) -> DataFrame:
    """The same by sums: each set pixel tells itself and its eight neighbours, and counts come
    together in one aggregation. A pixel told more than once is one, and its neighbours count for each."""
    on = pixels.where("v > 0").select(image, "y", "x")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), *Y._NEAR)]))
    own = (F.col("s.dy") == 0) & (F.col("s.dx") == 0)
    told = on.select(image, "y", "x", steps.alias("s")).select(image, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), own.alias("own"))
    counted = told.groupBy(image, "y", "x").agg(F.count_if("own").alias("times"), F.count_if(~F.col("own")).alias("n")).where("times > 0")
    n = F.when(F.col(image).isNotNull(), F.col("times") * F.col("n")).otherwise(0)
    return counted.select(image, n.alias("n")).groupBy(image).agg(F.count_if(F.col("n") >= 3).alias("junctions"), F.count_if(F.col("n") == 1).alias("ends"), F.count(F.lit(1)).alias("skeleton"))


def overlap(pixels: DataFrame, image: str, predicted: Column, wanted: Column) -> DataFrame:
    """Precision, recall, Dice and IoU of masks as sums over pixel rows."""
    s = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    tp, fp, fn = s(predicted & wanted), s(predicted & ~wanted), s(~predicted & wanted)
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return pixels.groupBy(image).agg(F.round(part(tp, tp + fp), 8).alias("precision"), F.round(part(tp, tp + fn), 8).alias("recall"), F.round(part(2 * tp, 2 * tp + fp + fn), 8).alias("dice"), F.round(part(tp, tp + fp + fn), 8).alias("iou"))


def suppress_segments(scored: DataFrame, image: str, k: int = 10, overlap: float = 0.35) -> DataFrame:
    """The best segments of an image whose pixels overlap little with better ones."""
    from tesserae.operators.graph import suppress

    return suppress(scored, image, "members", "score", k, overlap, of_smaller=True, reached=True)
