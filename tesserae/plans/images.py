"""Queries of image geometry over made polylines and masks: one branch or image for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import images as I
from tesserae.operators.blocks import spread
from tesserae.plans.registry import Tables, query

LINES = "p AS (SELECT s_suppkey AS branch, s_nationkey AS image, i, i * 1.0 AS x, 12 * sin(2 * pi() * i / (20 + s_suppkey % 30)) * (s_suppkey % 4) / 3.0 AS y FROM supplier, range(0, 120) r(i))"
PIXELS = "px AS (SELECT s_suppkey AS image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN y = 8 OR x = s_suppkey % 20 + 2 OR (x = y AND x < 6) THEN 1 ELSE 0 END AS v FROM supplier, range(0, 24) a(y), range(0, 24) b(x))"


def lines(t: Tables) -> DataFrame:
    i = t.supplier.select(F.col("s_suppkey").alias("branch"), F.col("s_nationkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(119))).alias("i"))
    return i.select("branch", "image", "i", F.col("i").cast("double").alias("x"), (12 * F.sin(2 * F.pi() * F.col("i") / (20 + F.col("branch") % 30)) * (F.col("branch") % 4) / 3.0).alias("y"))


def pixels(t: Tables) -> DataFrame:
    at = spread(t.supplier).select(F.col("s_suppkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("x"))
    return at.withColumn("v", F.when((F.col("y") == 8) | (F.col("x") == F.col("image") % 20 + 2) | ((F.col("x") == F.col("y")) & (F.col("x") < 6)), 1).otherwise(0))


CURVES = f"""WITH {LINES}, n AS (SELECT branch, image, i, y, x, lag(y) OVER w AS py, lag(x) OVER w AS px, lead(y) OVER w AS ny, lead(x) OVER w AS nx FROM p WINDOW w AS (PARTITION BY branch ORDER BY i)),
k AS (SELECT branch, 2 * abs((y - py) * (nx - x) - (x - px) * (ny - y)) / (sqrt((y - py) ** 2 + (x - px) ** 2) * sqrt((ny - y) ** 2 + (nx - x) ** 2) * sqrt((ny - py) ** 2 + (nx - px) ** 2)) AS k FROM n WHERE py IS NOT NULL AND ny IS NOT NULL),
l AS (SELECT branch, any_value(image) AS image, sum(sqrt((y - py) ** 2 + (x - px) ** 2)) AS len FROM n WHERE py IS NOT NULL GROUP BY branch),
b AS (SELECT l.branch, image, len, median(k) AS p50, quantile_cont(k, 0.75) AS p75, avg(k) AS mean FROM k JOIN l USING (branch) GROUP BY 1, 2, 3)"""


@query("W11 W14 G11 A20 A22", CURVES + " SELECT image, count(*) AS branches, " + ", ".join(f"round(coalesce(sum({s} * {w}) FILTER (WHERE {s} > 0) / sum({w}) FILTER (WHERE {s} > 0), 0), 9) AS {s}_{n}" for s in ("p50", "p75", "mean") for n, w in (("length", "greatest(len, 1)"), ("sqrt_length", "sqrt(greatest(len, 1))"))) + " FROM b GROUP BY image")
def curvature_bundle(t: Tables) -> DataFrame:
    b = I.curvature_bundle(lines(t), "image", "branch", "i")
    return b.select("image", "branches", *[F.round(c, 9).alias(c) for c in b.columns if c not in ("image", "branches")])


@query("G11 E08", CURVES + " SELECT branch, CASE WHEN p50 * 0.04 < 0.0008 THEN 'Straight' WHEN p50 * 0.04 < 0.004 THEN 'Wavy' ELSE 'Coiled' END AS label FROM b")
def curvature_labels(t: Tables) -> DataFrame:
    k = I.point_curvature(lines(t), "branch", "i").groupBy("branch").agg(F.percentile(F.col("k") * 0.04, F.lit(0.5)).alias("p50"))
    return k.select("branch", I.curvature_label(F.col("p50")).alias("label"))


@query("G12 W12 W13", None)
def waviness(t: Tables) -> DataFrame:
    return I.wave_rows(lines(t).select("branch", "y", "x"), "branch")


@query("G05", f"""WITH {LINES}, c AS (SELECT branch, image, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM p GROUP BY 1, 2),
a AS (SELECT image, n, CASE WHEN xx = 0 AND yy = 0 THEN 0 ELSE (1 + (yy - xx) / nullif(sqrt((xx - yy) ** 2 + 4 * xy * xy), 0)) / 2 END AS cos2 FROM c)
SELECT image, round((3 * sum(n * cos2) / sum(n) - 1) / 2, 8) AS factor, count(*) AS branches FROM a GROUP BY image""")
def orientation_pca(t: Tables) -> DataFrame:
    """The direction of each branch in closed form from its 2x2 covariance, weighted by size."""
    c = lines(t).groupBy("branch", "image").agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"))
    spread = F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2)
    a = c.select("image", "n", F.when(spread > 0, (1 + (F.col("yy") - F.col("xx")) / spread) / 2).alias("cos2"))
    return a.groupBy("image").agg(F.round((3 * F.sum(F.col("n") * F.col("cos2")) / F.sum("n") - 1) / 2, 8).alias("factor"), F.count(F.lit(1)).alias("branches"))


@query("G04 G13", f"""WITH {PIXELS}, o AS (SELECT image, y, x FROM px WHERE v > 0), n AS (SELECT a.image, a.y, a.x, count(b.y) AS n FROM o a LEFT JOIN o b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3)
SELECT image, count(*) FILTER (WHERE n >= 3) AS junctions, count(*) FILTER (WHERE n = 1) AS ends, count(*) AS skeleton FROM n GROUP BY image""")
def junctions(t: Tables) -> DataFrame:
    return I.junction_counts(pixels(t), "image")


@query("G04 G05 G06 G07 G08 G10 G14 G18", None)
def mask_figures(t: Tables) -> DataFrame:
    """Density, junctions, components, orientation, width, branch graph and rose of each mask."""
    return I.mask_rows(pixels(t), "image")


@query("G19", f"WITH {PIXELS}, s AS (SELECT image, sum(CASE WHEN v > 0 AND (x + y) % 3 > 0 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN v > 0 AND (x + y) % 3 = 0 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN v = 0 AND (x + y) % 3 > 0 THEN 1.0 ELSE 0 END) AS fn FROM px GROUP BY image) SELECT image, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS dice, round(tp / (tp + fp + fn), 8) AS iou FROM s")
def dice_iou(t: Tables) -> DataFrame:
    return I.overlap(pixels(t), "image", F.col("v") > 0, (F.col("x") + F.col("y")) % 3 > 0)


@query("G02", "SELECT s_suppkey, l, round(1024 / (518000.0 / (s_nationkey * 1000 + 5000)), 8) AS px_per_um, round(l * 1024 / (518000.0 / (s_nationkey * 1000 + 5000)), 6) AS least_px FROM supplier, (SELECT unnest([0, 1, 2, 4]) AS l)")
def threshold_profiles(t: Tables) -> DataFrame:
    """Each image at each of four length factors, a fixed parameter set."""
    scale = I.px_per_um(F.lit(1024), F.col("s_nationkey") * 1000 + 5000)
    each = t.supplier.select("s_suppkey", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 4)])).alias("l"), scale.alias("s"))
    return each.select("s_suppkey", "l", F.round("s", 8).alias("px_per_um"), F.round(F.col("l") * F.col("s"), 6).alias("least_px"))


@query("G20", "WITH s AS (SELECT p_partkey, 100 + p_size AS h, 80 + p_size * 2 AS w FROM part), a AS (SELECT p_partkey, w, y FROM s, unnest(list_distinct(list_append(range(0, greatest(h - 64, 0) + 1, 32), CAST(greatest(h - 64, 0) AS BIGINT)))) u(y)) SELECT p_partkey, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM a, unnest(list_distinct(list_append(range(0, greatest(w - 64, 0) + 1, 32), CAST(greatest(w - 64, 0) AS BIGINT)))) u(x)")
def patch_grid(t: Tables) -> DataFrame:
    """Corners of 64-pixel patches every 32 pixels, the last ones at the edges."""
    places = lambda n: F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.greatest(n - 64, F.lit(0)).cast("long"), F.lit(32).cast("long")), F.array(F.greatest(n - 64, F.lit(0)).cast("long")))))
    return t.part.select("p_partkey", "p_size", places(100 + F.col("p_size")).alias("y")).select("p_partkey", "y", places(80 + F.col("p_size") * 2).alias("x"))


@query("G15 K09", None)
def suppressed_segments(t: Tables) -> DataFrame:
    """The ten longest branches of each image that share few cells with a longer one."""
    cell = F.concat_ws(":", F.floor(F.col("x") / 8), F.floor(F.col("y") / 8))
    s = lines(t).groupBy("image", F.col("branch").alias("id")).agg(F.collect_set(cell).alias("members"), F.round(F.sum(F.abs("y")) + F.count(F.lit(1)), 6).alias("score"))
    return I.suppress_segments(s, "image")


@query("G17", CURVES + ", " + "f AS (SELECT b.*, x AS factor, len >= x * 25 AS ok FROM b, (SELECT unnest([0.0, 1.0, 2.0, 5.0, 6.0]) AS x)) SELECT image, CAST(factor AS DOUBLE) AS factor, count(*) FILTER (WHERE ok) AS branches, round(coalesce(sum(p75 * sqrt(greatest(len, 1))) FILTER (WHERE ok AND p75 > 0) / sum(sqrt(greatest(len, 1))) FILTER (WHERE ok AND p75 > 0), 0), 9) AS p75_sqrt_length FROM f GROUP BY image, factor")
def branch_profiles(t: Tables) -> DataFrame:
    """Curvatures of each image's branches at five length factors."""
    p = I.branch_profiles(lines(t), "image", "branch", "i", [0, 1, 2, 5, 6], 25.0)
    return p.select("image", "factor", "branches", F.round("p75_sqrt_length", 9).alias("p75_sqrt_length"))


def barred(t: Tables) -> DataFrame:
    """Images of 300 rows with a dark bar below."""
    at = t.supplier.select(F.col("s_suppkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(299))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("x"))
    return at.withColumn("v", F.when(F.col("y") >= 180 + F.col("image") % 60, 0).otherwise(100))


@query("G01", "SELECT s_suppkey AS image, CAST(least(225, 180 + s_suppkey % 60) + 10 AS BIGINT) AS rows FROM supplier")
def image_regions(t: Tables) -> DataFrame:
    return I.regions(barred(t), "image")


@query("G03", None)
def image_foregrounds(t: Tables) -> DataFrame:
    """Foreground of each image after contrast and threshold: the lines on it."""
    return I.foregrounds(pixels(t).withColumn("v", F.col("v") * 200 + 20), "image")
