"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import evaluate as E
from tesserae.plans.registry import Tables, query

CLASSES = ["straight", "wavy", "coiled"]
ROWS = "r AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, CASE WHEN l_extendedprice < 20000 THEN 'straight' WHEN l_extendedprice < 50000 THEN 'wavy' ELSE 'coiled' END AS w FROM lineitem)"


def rows(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    return t.lineitem.select(F.col("l_quantity").alias("s"), F.when(price < 20000, "straight").when(price < 50000, "wavy").otherwise("coiled").alias("w"))


TOLD = "t AS (SELECT w, CASE WHEN s <= 15 THEN 'straight' WHEN s <= 35 THEN 'wavy' ELSE 'coiled' END AS p FROM r)"


@query("E07 E08", f"WITH {ROWS}, {TOLD}, n AS (SELECT w AS wanted, p AS told, count(*) AS n FROM t GROUP BY ALL) SELECT wanted, told, n, round(n / sum(n) OVER (PARTITION BY wanted), 8) AS share FROM n")
def confusion_matrix(t: Tables) -> DataFrame:
    c = E.confusion(rows(t), F.col("w"), E.banded(F.col("s"), F.lit(15), F.lit(35)))
    return c.withColumn("share", F.round("share", 8))


KAPPA = """, n AS (SELECT w, p, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT unnest(['straight', 'wavy', 'coiled']) AS c, unnest([0, 1, 2]) AS i),
per AS (SELECT c, i, (SELECT coalesce(sum(n), 0) FROM n WHERE w = c) AS rw, (SELECT coalesce(sum(n), 0) FROM n WHERE p = c) AS cl, (SELECT coalesce(sum(n), 0) FROM n WHERE w = c AND p = c) AS hit FROM k), tot AS (SELECT sum(n) AS n FROM n)
SELECT round((SELECT sum(hit) FROM per) / tot.n, 8) AS accuracy, round((SELECT sum(CASE WHEN rw + cl > 0 THEN 2.0 * hit / (rw + cl) ELSE 0 END) FROM per) / 3, 8) AS macro_f1,
 round((SELECT avg(hit / rw) FROM per WHERE rw > 0), 8) AS balanced_accuracy,
 round(1 - (SELECT sum((a.i - b.i) ** 2 * n.n) FROM n JOIN k a ON a.c = w JOIN k b ON b.c = p) / (SELECT sum((a.i - b.i) ** 2 * a.rw * b.cl / tot.n) FROM per a, per b), 8) AS weighted_kappa FROM tot"""


@query("E07", f"WITH {ROWS}, {TOLD}{KAPPA}")
def class_metrics(t: Tables) -> DataFrame:
    c = E.confusion(rows(t), F.col("w"), E.banded(F.col("s"), F.lit(15), F.lit(35)))
    return E.class_metrics(c, CLASSES)


@query("K11 W15 E08", f"""WITH {ROWS}, d AS (SELECT DISTINCT s FROM r), p AS (SELECT a.s AS low, b.s AS high FROM d a JOIN d b ON a.s < b.s), n AS (SELECT s, w, count(*) AS n FROM r GROUP BY ALL), tot AS (SELECT w, sum(n) AS t FROM n GROUP BY w),
c AS (SELECT low, high, w, CASE WHEN s <= low THEN 'straight' WHEN s <= high THEN 'wavy' ELSE 'coiled' END AS p, sum(n) AS n FROM p, n GROUP BY ALL), told AS (SELECT low, high, p, sum(n) AS m FROM c GROUP BY ALL),
f AS (SELECT p.low, p.high, tot.w, tot.t, coalesce(h.n, 0) AS hit, coalesce(m, 0) AS m FROM p CROSS JOIN tot LEFT JOIN c h ON h.low = p.low AND h.high = p.high AND h.w = tot.w AND h.p = tot.w LEFT JOIN told x ON x.low = p.low AND x.high = p.high AND x.p = tot.w)
SELECT low, high, round(avg(2.0 * hit / (t + m)), 9) AS macro_f1, round(avg(hit / t), 9) AS balanced_accuracy, round(sum(hit) / sum(t), 9) AS accuracy FROM f GROUP BY low, high ORDER BY macro_f1 DESC, balanced_accuracy DESC, accuracy DESC, low, high LIMIT 1""")
def best_thresholds(t: Tables) -> DataFrame:
    return E.best_thresholds(rows(t), "s", "w")


@query("E09", "WITH v AS (SELECT event_type AS variant, avg(value) AS score FROM events GROUP BY 1) SELECT variant, round(score, 8) AS score, round(score - b, 8) AS delta, round((score - b) / b * 100, 6) AS percent FROM v, (SELECT score AS b FROM v WHERE variant = 'view')")
def ablation(t: Tables) -> DataFrame:
    v = t.events.groupBy(F.col("event_type").alias("variant")).agg(F.avg("value").alias("score"))
    out = E.against_baseline(v, "variant", "score", "view")
    return out.select("variant", F.round("score", 8).alias("score"), F.round("delta", 8).alias("delta"), F.round("percent", 6).alias("percent"))


@query("E10", "SELECT tag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM (SELECT 'full' AS tag, * FROM lineitem UNION ALL SELECT 'quantity_40', * FROM lineitem WHERE l_quantity = 40 UNION ALL SELECT 'tax_0', * FROM lineitem WHERE l_tax = 0) GROUP BY tag HAVING count(*) >= 25 AND stddev_pop(l_extendedprice) > 0")
def subset_baselines(t: Tables) -> DataFrame:
    """Tagged subsets from one scan: a row counts for each subset it belongs to."""
    tags = F.filter(F.array(F.lit("full"), F.when(F.col("l_quantity") == 40, "quantity_40"), F.when(F.col("l_tax") == 0, "tax_0")), lambda x: x.isNotNull())
    g = t.lineitem.select(F.explode(tags).alias("tag"), "l_extendedprice").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("s"))
    return g.where("n >= 25 AND s > 0").select("tag", "n", F.round("mean", 4).alias("mean"))


@query("E12", "SELECT o_custkey, len(list_distinct(list_concat(a, b))) AS n, list_sum(list_distinct(list_concat(a, b))) AS total FROM (SELECT o_custkey, coalesce(list(o_orderkey) FILTER (WHERE o_orderpriority LIKE '1%'), []) AS a, coalesce(list(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), []) AS b FROM orders GROUP BY 1) WHERE len(a) + len(b) > 0")
def merged_labels(t: Tables) -> DataFrame:
    ids = lambda c: F.collect_list(F.when(c, F.col("o_orderkey")))
    g = t.orders.groupBy("o_custkey").agg(F.array_union(ids(F.col("o_orderpriority").like("1%")), ids(F.col("o_orderstatus") == "F")).alias("u"))
    return g.where(F.size("u") > 0).select("o_custkey", F.size("u").alias("n"), F.aggregate("u", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("E13 E14", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) * 1.0 / count(*) AS variety, round(0.5 * avg(value) / 100 + 0.3 * (count(DISTINCT event_type) / 5.0) + 0.2 * least(count(*) / 10.0, 1), 6) AS relevance, 0.5 * avg(value) / 100 + 0.3 * (count(DISTINCT event_type) / 5.0) + 0.2 * least(count(*) / 10.0, 1) > 0.4 AS relevant FROM events GROUP BY user_id")
def relevance_scores(t: Tables) -> DataFrame:
    kinds, n = F.countDistinct("event_type"), F.count(F.lit(1))
    s = 0.5 * F.avg("value") / 100 + 0.3 * (kinds / 5.0) + 0.2 * F.least(n / 10.0, F.lit(1.0))
    return t.events.groupBy("user_id").agg(n.alias("n"), (kinds / n).alias("variety"), F.round(s, 6).alias("relevance"), (s > 0.4).alias("relevant"))
