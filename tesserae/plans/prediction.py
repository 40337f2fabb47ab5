"""Queries of prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import numeric
from tesserae.operators import predict as P
from tesserae.operators.blocks import spread
from tesserae.plans.registry import Tables, query

FEATURES = ["a", "b"]
POOL = """pool AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS a, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 97 * 1.0 END AS y FROM customer),
sc AS (SELECT greatest(stddev_pop(a), 0.000001) AS sa, greatest(stddev_pop(b), 0.000001) AS sb FROM pool), q AS (SELECT id AS qid, a AS qa, b AS qb FROM pool WHERE id % 20 = 0),
d AS (SELECT qid, id, y, round((abs(a - qa) / sa + coalesce(abs(b - qb) / sb, 0)) / (1 + CASE WHEN b IS NOT NULL AND qb IS NOT NULL THEN 1 ELSE 0 END), 9) AS d FROM pool, sc, q WHERE id <> qid AND y IS NOT NULL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM d) WHERE rank <= 5)"""


def pool(t: Tables) -> DataFrame:
    return spread(t.customer).select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("a"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("b"), F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey") % 97 * 1.0).alias("y"))


def near(t: Tables) -> DataFrame:
    p = pool(t)
    return P.neighbours(p, p.where("id % 20 = 0").withColumnRenamed("id", "qid"), FEATURES, "y")


@query("J17 F25 K03 K04", f"WITH {POOL} SELECT qid, id, y, round(d, 6) AS d, rank FROM near")
def knn_similar(t: Tables) -> DataFrame:
    """Five most similar rows of every twentieth row against all."""
    return near(t).select("qid", "id", "y", F.round("d", 6).alias("d"), "rank")


@query("A20 U07", f"WITH {POOL} SELECT qid, round(sum(y / greatest(d, 0.000001)) / sum(1 / greatest(d, 0.000001)), 6) AS baseline, count(*) AS n FROM near GROUP BY qid")
def idw_baseline(t: Tables) -> DataFrame:
    return P.inverse_distance(near(t)).select("qid", F.round("baseline", 6).alias("baseline"), "n")


@query("A20", f"WITH {POOL}, b AS (SELECT qid, sum(y / greatest(d, 0.000001)) / sum(1 / greatest(d, 0.000001)) AS base FROM near GROUP BY qid) SELECT qid, round(pool.y - base, 6) AS residual FROM b JOIN pool ON id = qid WHERE pool.y IS NOT NULL")
def loo_residuals(t: Tables) -> DataFrame:
    """What a model has to learn beyond each row's own neighbours."""
    b = P.inverse_distance(near(t))
    return b.join(pool(t).select(F.col("id").alias("qid"), "y"), "qid").where("y IS NOT NULL").select("qid", F.round(F.col("y") - F.col("baseline"), 6).alias("residual"))


@query("U16 F24", """
WITH r AS (SELECT p_partkey AS id, p_size % 3 AS fold, CAST(p_size AS DOUBLE) AS a, p_retailprice + 10.0 * p_size AS y FROM part),
t AS (SELECT q.id, q.fold, q.a, q.y, p.fold AS g, sum(exp(-abs(q.a - p.a) / 5.0)) AS w, sum(exp(-abs(q.a - p.a) / 5.0) * p.y) AS wy FROM r q JOIN r p ON p.id <> q.id GROUP BY ALL),
b AS (SELECT id, fold, a, y, f, sum(wy) / sum(w) AS base FROM t, (SELECT unnest([0, 1, 2]) AS f) WHERE g <> f GROUP BY id, fold, a, y, f),
m AS (SELECT f, regr_slope(y - base, a) AS slope, regr_intercept(y - base, a) AS intercept FROM b WHERE fold <> f GROUP BY f)
SELECT fold, count(*) AS n, round(avg(abs(y - base)), 4) AS baseline_mae, round(avg(abs(y - base - slope * a - intercept)), 4) AS mae FROM b JOIN m USING (f) WHERE fold = f GROUP BY fold""")
def residual_folds(t: Tables) -> DataFrame:
    """A similarity baseline and a model of its residuals, fitted anew for each fold: errors out of fold."""
    rows = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("fold"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") + 10.0 * F.col("p_size")).alias("y"))
    told = P.residual_cv(spread(rows), ["a"], "y", [5.0], 3)
    return told.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("baseline"))), 4).alias("baseline_mae"), F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 4).alias("mae"))


@query("F36", "SELECT p_partkey, greatest(0.1, least(CASE WHEN p_size % 10 = 0 THEN least(c, 0.35) ELSE c END, 0.98)) AS confidence FROM (SELECT p_partkey, p_size, 0.35 + least(p_size % 6 * 0.07, 0.28) + least(p_size % 4 * 0.04, 0.12) + coalesce(greatest(least(CASE WHEN p_size % 3 > 0 THEN p_size / 50.0 - 0.3 END, 0.2), -0.05), 0) AS c FROM part)")
def prediction_confidence(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", numeric.confidence(s % 6, s % 4, F.when(s % 3 > 0, s / 50.0 - 0.3), F.when(s % 10 == 0, 1).otherwise(0)).alias("confidence"))


@query("F37", "WITH l AS (SELECT n_nationkey % 5 AS f, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END AS sign, n_nationkey / 25.0 AS conf FROM nation WHERE n_nationkey < 12) SELECT s_suppkey, round(sum(conf * (s_nationkey + f)) FILTER (WHERE sign > 0), 8) AS up, round(sum(conf * (s_nationkey + f)) FILTER (WHERE sign < 0), 8) AS down FROM supplier, l GROUP BY s_suppkey")
def prior_features(t: Tables) -> DataFrame:
    """Signed sums over twelve known links for every row."""
    known = t.nation.where("n_nationkey < 12").select((F.col("n_nationkey") % 5).alias("f"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1).alias("sign"), (F.col("n_nationkey") / 25.0).alias("conf"))
    v = F.col("conf") * (F.col("s_nationkey") + F.col("f"))
    return t.supplier.crossJoin(F.broadcast(known)).groupBy("s_suppkey").agg(F.round(F.sum(F.when(F.col("sign") > 0, v)), 8).alias("up"), F.round(F.sum(F.when(F.col("sign") < 0, v)), 8).alias("down"))  # twelve rows


def modelled(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name"), (F.col("p_retailprice") + F.col("p_size") * 10).alias("price"), (1 + F.col("p_partkey") % 3).cast("double").alias("w"))
    return P.folds(rows, "p_brand", 3)


@query("U08 U09 U10", None)
def grouped_ridge(t: Tables) -> DataFrame:
    """Ridge regression, cross-validated by brand and weighted: errors out of fold."""
    from pyspark.ml.regression import LinearRegression

    told = P.cross_validated(modelled(t), ["size", "name"], "price", lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0), 3, "w")
    return P.errors(told).withColumn("model", F.lit("ridge"))


@query("U08 U11 U15 E10", None)
def grouped_trees(t: Tables) -> DataFrame:
    """Random forest and elastic net on a log target, cross-validated by brand."""
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    rows = modelled(t).withColumn("price", F.log1p("price"))
    out = []
    for name, make in (("forest", lambda: RandomForestRegressor(numTrees=10, maxDepth=4, seed=1)), ("elastic_net", lambda: LinearRegression(regParam=0.01, elasticNetParam=0.5))):
        told = P.cross_validated(rows, ["size", "name"], "price", make, 3)
        told = told.withColumn("label", F.expm1("label")).withColumn("prediction", F.expm1("prediction"))
        out.append(P.errors(told).withColumn("model", F.lit(name)))
    return out[0].unionByName(out[1])
