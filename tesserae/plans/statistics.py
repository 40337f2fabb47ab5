"""Queries of statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import catalog as C
from tesserae.operators import predict as P
from tesserae.operators import stats as S
from tesserae.operators.blocks import spread
from tesserae.plans.registry import Tables, query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A02 A03", "WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS event_type) SELECT event_type, count(event_id) AS n FROM k LEFT JOIN events USING (event_type) GROUP BY event_type")
def default_zero_categories(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([(x,) for x in "click error purchase refund signup view".split()], "event_type string")
    n = t.events.groupBy(F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("unknown")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("A04 A43", "SELECT event_type, user_id % 3 AS part, round(avg(value), 3) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), ())")
def grouping_sets(t: Tables) -> DataFrame:
    """Totals by kind, by part and in all, from one pass."""
    e = t.events.select("event_type", (F.col("user_id") % 3).alias("part"), "value")
    return t.spark.sql("SELECT event_type, part, round(avg(value), 3) AS mean, count(*) AS n FROM {e} GROUP BY GROUPING SETS ((event_type), (part), ())", e=e)


@query("A05 A06", "SELECT 'lang' AS field, round(100.0 * count(CASE WHEN lang <> '' THEN 1 END) / count(*), 4) AS filled, avg(length(lang)) AS mean, min(length(lang)) AS least, max(length(lang)) AS most FROM documents UNION ALL SELECT 'text', round(100.0 * count(CASE WHEN text <> '' THEN 1 END) / count(*), 4), avg(length(text)), min(length(text)), max(length(text)) FROM documents")
def completeness(t: Tables) -> DataFrame:
    long = S.unpivot(t.documents.select("doc_id", "lang", "text"), ["doc_id"], ["lang", "text"], "field", "v")
    return long.groupBy("field").agg(F.round(100.0 * F.count_if(F.col("v") != "") / F.count(F.lit(1)), 4).alias("filled"), F.avg(F.length("v")).alias("mean"), F.min(F.length("v")).alias("least"), F.max(F.length("v")).alias("most"))


@query("A07", "SELECT avg(n) AS per_customer, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def nested_average(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    per = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.avg("n").alias("per_customer"), F.count(F.lit(1)).alias("customers"))


@query("A08 A31", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(DISTINCT l_partkey) * 1.0 / (SELECT count(*) FROM part) AS coverage FROM lineitem GROUP BY l_returnflag")
def distinct_coverage(t: Tables) -> DataFrame:
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    d = t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_partkey", "l_suppkey").alias("pairs"))
    return d.crossJoin(F.broadcast(n)).select("l_returnflag", "parts", "pairs", (F.col("parts") / F.col("n")).alias("coverage"))


@query("A09", "SELECT user_id, event_type, value, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("A10", "WITH a AS (SELECT l_suppkey AS k, count(*) AS a FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, a, coalesce(b, 0) AS b FROM a LEFT JOIN b USING (k) WHERE coalesce(b, 0) < 0.25 * a")
def having_counts(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return g.where("b < 0.25 * a")


@query("A11 A12 A13 A19", "SELECT coalesce(CAST(CASE WHEN l_linenumber < 6 THEN l_linenumber END AS VARCHAR), 'None') AS g, l_returnflag, round(avg(l_quantity), 6) AS quantity_mean, round(stddev_samp(l_quantity), 6) AS quantity_std, count(l_quantity) AS quantity_count, round(avg(l_tax), 6) AS tax_mean FROM lineitem GROUP BY ALL")
def grouped_stats(t: Tables) -> DataFrame:
    g = F.coalesce(F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).cast("string"), F.lit("None"))
    return t.lineitem.groupBy(g.alias("g"), "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("quantity_mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("quantity_std"), F.count("l_quantity").alias("quantity_count"), F.round(F.avg("l_tax"), 6).alias("tax_mean"))


@query("A14 P20", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS least, max({c}) AS most FROM lineitem" for c in NUM))
def feature_quality(t: Tables) -> DataFrame:
    long = S.unpivot(t.lineitem.select("l_orderkey", *NUM), ["l_orderkey"], NUM)
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.round(100.0 * (F.count(F.lit(1)) - F.count("value")) / F.count(F.lit(1)), 6).alias("missing"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("A15", "SELECT l_suppkey, coalesce(avg(l_quantity) FILTER (WHERE l_linenumber = 7), avg(l_quantity) FILTER (WHERE l_linenumber = 6), avg(l_quantity) FILTER (WHERE l_linenumber = 1)) AS v FROM lineitem GROUP BY l_suppkey")
def priority_feature(t: Tables) -> DataFrame:
    """The mean at the best resolution that has values."""
    return t.lineitem.groupBy("l_suppkey").agg(F.coalesce(*[F.avg(F.when(F.col("l_linenumber") == m, F.col("l_quantity"))) for m in (7, 6, 1)]).alias("v"))


@query("A16 A17", "SELECT l_linenumber, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS \"A\", avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS \"N\", avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY l_linenumber")
def pivot_mean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_extendedprice"))


@query("A18", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) > 0")
def crosstab(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("view", "click", "error")).groupBy("user_id").pivot("event_type", ["view", "click", "error"]).count().fillna(0)


@query("A20 U07", "SELECT l_suppkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS by_length, sum(l_extendedprice * sqrt(l_quantity)) / sum(sqrt(l_quantity)) AS by_root, sum(l_extendedprice / greatest(l_discount, 0.000001)) / sum(1 / greatest(l_discount, 0.000001)) AS by_inverse FROM lineitem GROUP BY l_suppkey")
def weighted_means(t: Tables) -> DataFrame:
    v, w, d = F.col("l_extendedprice"), F.col("l_quantity"), F.greatest("l_discount", F.lit(1e-6))
    return t.lineitem.groupBy("l_suppkey").agg((F.sum(v * w) / F.sum(w)).alias("by_length"), (F.sum(v * F.sqrt(w)) / F.sum(F.sqrt(w))).alias("by_root"), (F.sum(v / d) / F.sum(1 / d)).alias("by_inverse"))


@query("A21 U07", "WITH q AS (SELECT l_partkey, quantile_cont(l_quantity, [0.1, 0.9]) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, avg(l_quantity) AS trimmed FROM lineitem JOIN q USING (l_partkey) WHERE n < 5 OR l_quantity BETWEEN q[1] AND q[2] GROUP BY l_partkey")
def trimmed_means(t: Tables) -> DataFrame:
    return S.trimmed_mean(t.lineitem.select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity")


@query("A22 A23", "SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.3) AS p30, median(l_quantity) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def distribution_summary(t: Tables) -> DataFrame:
    q = F.percentile("l_quantity", F.array(*[F.lit(p) for p in (0.25, 0.3, 0.5, 0.75)]))
    g = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"), F.min("l_quantity").alias("least"), q.alias("q"), F.max("l_quantity").alias("most"))
    return g.select("l_returnflag", "n", "mean", "std", "least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p30"), F.col("q")[2].alias("p50"), F.col("q")[3].alias("p75"), "most")


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@query("A24 A26", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in PAIRS))
def pearson_matrix(t: Tables) -> DataFrame:
    return S.correlations(t.lineitem.select(*NUM), NUM).withColumn("r", F.round("r", 8))


@query("A25 A27 W05", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code, l_tax FROM lineitem)
SELECT round(corr(x, y), 8) AS spearman, round(corr(code, l_tax), 8) AS coded FROM r""")
def spearman(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_discount", F.expr("CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END").alias("code"), "l_tax")
    ranked = S.with_rank(S.with_rank(rows, "l_quantity", [], "x"), "l_discount", [], "y")
    return ranked.agg(F.round(S.pearson(F.col("x"), F.col("y")), 8).alias("spearman"), F.round(S.pearson(F.col("code"), F.col("l_tax")), 8).alias("coded"))


@query("A28", """
WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 1009 + 1) / 5000.0 AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS i, count(*) OVER () AS n FROM p)
SELECT c_custkey, p, round(least(1, min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""")
def fdr_adjusted(t: Tables) -> DataFrame:
    """Benjamini-Hochberg adjustment of p-values with ties."""
    p = t.customer.select("c_custkey", ((F.col("c_custkey") * 7919 % 1009 + 1) / 5000.0).alias("p"))
    return S.benjamini_hochberg(p).withColumn("q", F.round("q", 9))


@query("A24 A28", None)
def correlation_tests(t: Tables) -> DataFrame:
    """Correlations of all pairs of columns with p-values and their adjustment: six rows."""
    columns = [S.pearson(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(PAIRS)]
    found = t.lineitem.agg(F.count(F.lit(1)).alias("n"), *columns).first()
    p = S.correlation_p(np.array([found[f"r{k}"] or 0.0 for k in range(len(PAIRS))]), np.full(len(PAIRS), found["n"]))
    told = [(a, b, found[f"r{k}"], float(p[k])) for k, (a, b) in enumerate(PAIRS)]
    return S.benjamini_hochberg(t.spark.createDataFrame(told, "a string, b string, r double, p double"))


@query("A29 A30", "SELECT 'ols' AS method, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def ols_coefficients(t: Tables) -> DataFrame:
    method, n, c = S.least_squares(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.createDataFrame([(method, n, round(c[0], 4), round(c[1], 4))], "method string, n long, intercept double, slope double")


@query("A30", "SELECT l_suppkey, count(CASE WHEN l_linenumber < 5 THEN l_tax END) AS tax, count(CASE WHEN l_quantity > 25 THEN l_discount END) AS discount, CASE WHEN count(CASE WHEN l_linenumber < 5 THEN l_tax END) = count(*) THEN 'labelled' WHEN count(CASE WHEN l_linenumber < 5 THEN l_tax END) = 0 THEN 'unlabelled' ELSE 'partial' END AS status FROM lineitem GROUP BY l_suppkey")
def label_status(t: Tables) -> DataFrame:
    tax = F.count(F.when(F.col("l_linenumber") < 5, F.col("l_tax")))
    return t.lineitem.groupBy("l_suppkey").agg(tax.alias("tax"), F.count(F.when(F.col("l_quantity") > 25, F.col("l_discount"))).alias("discount"), F.when(tax == F.count(F.lit(1)), "labelled").when(tax == 0, "unlabelled").otherwise("partial").alias("status"))


@query("A32 K07", "WITH g AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS mean, list_sort(list(DISTINCT p_name))[1:3] AS names FROM part GROUP BY 1, 2) SELECT p_brand, p_type, n, round(mean, 6) AS mean, array_to_string(names, '|') AS names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, round(mean, 6) DESC, p_type) AS rn FROM g) WHERE rn <= 5")
def theme_aggregation(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.array_join(F.slice(F.sort_array(F.collect_set("p_name")), 1, 3), "|").alias("names"))
    return C.best_per(g, ["p_brand"], [F.desc("n"), F.desc("mean"), F.asc("p_type")], 5)


@query("A36", "SELECT event_type, user_id % 4 AS part, count(*) AS n, count(*) FILTER (WHERE value > 50) AS ok, round(count(*) FILTER (WHERE value > 50) * 100.0 / count(*), 4) AS rate FROM events GROUP BY ROLLUP (event_type, user_id % 4)")
def success_rates(t: Tables) -> DataFrame:
    e = t.events.select("event_type", (F.col("user_id") % 4).alias("part"), "value")
    return e.rollup("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("ok"), F.round(F.count_if(F.col("value") > 50) * 100.0 / F.count(F.lit(1)), 4).alias("rate"))


@query("A37 U07", """
WITH g AS (SELECT l_suppkey, l_linenumber, count(*) AS n, var_samp(l_quantity) AS var FROM lineitem GROUP BY 1, 2), m AS (SELECT coalesce(median(var) FILTER (WHERE var <> 0), 1.0) AS g FROM g),
s AS (SELECT l_suppkey, l_linenumber, n, n / (n + 2.0) * coalesce(var, g) + 2.0 / (n + 2.0) * g AS shrunk, g FROM g, m), r AS (SELECT *, 1 / (shrunk + 0.05 * g) AS raw FROM s), q AS (SELECT quantile_cont(raw, 0.05) AS lo, quantile_cont(raw, 0.95) AS hi FROM r),
w AS (SELECT *, least(greatest(raw, lo), hi) AS w FROM r, q)
SELECT l_suppkey, l_linenumber, n, round(shrunk, 7) AS shrunk, round(w / avg(w) OVER (), 9) AS weight FROM w""")
def noise_weights(t: Tables) -> DataFrame:
    w = S.noise_weights(t.lineitem, ["l_suppkey", "l_linenumber"], "l_quantity")
    return w.select("l_suppkey", "l_linenumber", "n", F.round("shrunk", 7).alias("shrunk"), F.round("weight", 9).alias("weight"))


@query("A38 K06", """
WITH q AS (SELECT quantile_cont(s_acctbal, [0.25, 0.75]) AS a, quantile_cont(s_nationkey, [0.25, 0.75]) AS b FROM supplier),
r AS (SELECT s_suppkey, list_filter([CASE WHEN s_acctbal < a[1] - 0.1 * (a[2] - a[1]) THEN 's_acctbal:low_iqr' WHEN s_acctbal > a[2] + 0.1 * (a[2] - a[1]) THEN 's_acctbal:high_iqr' END, CASE WHEN s_nationkey < b[1] - 0.1 * (b[2] - b[1]) THEN 's_nationkey:low_iqr' WHEN s_nationkey > b[2] + 0.1 * (b[2] - b[1]) THEN 's_nationkey:high_iqr' END], lambda x: x IS NOT NULL) AS why FROM supplier, q)
SELECT s_suppkey, array_to_string(why, ',') AS anomaly_reasons, len(why) AS anomaly_flag_count FROM r""")
def iqr_outliers(t: Tables) -> DataFrame:
    out = S.iqr_flags(t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey"), ["s_acctbal", "s_nationkey"], 0.1)
    return out.select("s_suppkey", "anomaly_reasons", "anomaly_flag_count").orderBy(F.desc("anomaly_flag_count"), "s_suppkey")


@query("A39", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 8) AS z FROM customer")
def zscore_population(t: Tables) -> DataFrame:
    return S.z_scores(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal_zscore", 8).alias("z"))


@query("A40", "WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, least(12, greatest(5, CAST(round(sqrt(count(*))) AS INT))) AS k FROM lineitem) SELECT least(k - 1, CAST(floor((l_quantity - lo) / (hi - lo) * k) AS INT)) AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem, b GROUP BY 1")
def binned_trend(t: Tables) -> DataFrame:
    """Means over five to twelve bins of equal width, by the root of the number of rows."""
    b = t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.least(F.lit(12), F.greatest(F.lit(5), F.round(F.sqrt(F.count(F.lit(1)))).cast("int"))).alias("k"))
    rows = t.lineitem.select("l_quantity", "l_extendedprice").crossJoin(F.broadcast(b))  # one row
    at = F.least(F.col("k") - 1, F.floor((F.col("l_quantity") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")).cast("int"))
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("A41", "SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def modes(t: Tables) -> DataFrame:
    """The commonest kind, ties by name."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("mode"))


@query("A44", """
WITH test AS (SELECT s_suppkey AS k, s_nationkey AS a, s_acctbal AS b FROM supplier WHERE s_suppkey % 20 = 0), train AS (SELECT c_nationkey AS a, c_acctbal AS b, c_custkey % 97 AS y FROM customer),
w AS (SELECT k, y, exp(-abs(test.a - train.a) / 5.0) * exp(-abs(test.b - train.b) / 2000.0) AS w FROM test, train), q AS (SELECT k, quantile_cont(w, 0.75) AS p FROM w GROUP BY k)
SELECT k, round(sum(w * y) / sum(w), 8) AS mean, round(sqrt(greatest(sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2, 0)), 6) AS sigma, count(*) FILTER (WHERE w > p) AS support, round(max(w), 8) AS top FROM w JOIN q USING (k) GROUP BY k""")
def kernel_baseline(t: Tables) -> DataFrame:
    """Kernel-weighted means of a stated query set (every twentieth supplier) over the pool."""
    test = t.supplier.where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("a"), F.col("s_acctbal").alias("b"))
    train = t.customer.select("c_custkey", F.col("c_nationkey").alias("a"), F.col("c_acctbal").alias("b"), (F.col("c_custkey") % 97).alias("y"))
    q = P.kernel_summary(spread(train), test, ["a", "b"], "y", [5.0, 2000.0], 0.75, "c_custkey", "k")
    return q.select("k", F.round("m", 8).alias("mean"), F.round(F.sqrt(F.greatest(F.col("m2") - F.col("m") ** 2, F.lit(0.0))), 6).alias("sigma"), "support", F.round("top", 8).alias("top"))


@query("A46", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def trend_lines(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


RANK_SQL = "(rank() OVER (PARTITION BY l_returnflag ORDER BY {c} {way}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY l_returnflag)"


@query("W01 W02", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, ({RANK_SQL.format(c='l_quantity', way='ASC')} + {RANK_SQL.format(c='l_tax', way='ASC')} + {RANK_SQL.format(c='l_discount', way='DESC')}) / 3 AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, round(score, 9) AS score, rank() OVER (PARTITION BY l_returnflag ORDER BY round(score, 9) DESC) AS place FROM s""")
def bend_score(t: Tables) -> DataFrame:
    """Mean of percentile ranks, one of them reversed, and the place in the group."""
    s = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax", "l_discount")
    for k, (c, up) in enumerate((("l_quantity", True), ("l_tax", True), ("l_discount", False))):
        s = S.with_rank(s, c, ["l_returnflag"], f"r{k}", up, percent=True)
    s = s.select("l_orderkey", "l_linenumber", "l_returnflag", F.round((F.col("r0") + F.col("r1") + F.col("r2")) / 3, 9).alias("score"))
    places = S.value_places(s, "score", ["l_returnflag"]).select(F.col("l_returnflag").alias("g"), F.col("score").alias("v"), (F.col("total") - F.col("below") - F.col("n") + 1).cast("int").alias("place"))
    return s.join(places, (F.col("l_returnflag") == F.col("g")) & (F.col("score") == F.col("v"))).select("l_orderkey", "l_linenumber", "score", "place")


@query("W06", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, rn, CASE WHEN rn <= ceil(n * 0.2) THEN 1 WHEN rn <= ceil(n * 0.5) THEN 2 ELSE 3 END AS tier FROM r")
def tiers(t: Tables) -> DataFrame:
    """Places by balance, ties by key, and tiers."""
    rows = t.supplier.where("s_acctbal IS NOT NULL").select("s_suppkey", "s_acctbal")
    places = S.value_places(rows, "s_acctbal", []).select(F.col("s_acctbal").alias("v"), (F.col("total") - F.col("below") - F.col("n")).alias("above"), "total")
    tie = F.row_number().over(Window.partitionBy("s_acctbal").orderBy("s_suppkey"))
    r = rows.withColumn("tie", tie).join(places, F.col("s_acctbal") == F.col("v")).select("s_suppkey", (F.col("above") + F.col("tie")).alias("rn"), F.col("total").alias("n"))
    return r.select("s_suppkey", "rn", F.when(F.col("rn") <= F.ceil(F.col("n") * 0.2), 1).when(F.col("rn") <= F.ceil(F.col("n") * 0.5), 2).otherwise(3).alias("tier"))


@query("W07 W15", "WITH train AS (SELECT DISTINCT l_quantity AS x, cume_dist() OVER (ORDER BY l_quantity) AS f FROM lineitem WHERE l_returnflag = 'N') SELECT l_orderkey, l_linenumber, coalesce((SELECT max(f) FROM train WHERE x <= l.l_quantity), 0) AS ecdf FROM lineitem l WHERE l_returnflag = 'R'")
def ecdf_vs_train(t: Tables) -> DataFrame:
    """Share of training values up to each value, from counts of the distinct values of both sides."""
    both = t.lineitem.where("l_returnflag IN ('N', 'R')").select(F.col("l_quantity").alias("x"), "l_returnflag")
    f = S.value_places(both, "x", [], (F.col("l_returnflag") == "N").cast("long")).select("x", ((F.col("below") + F.col("n")) / F.col("total")).alias("ecdf"))
    return t.lineitem.where("l_returnflag = 'R'").join(f, F.col("l_quantity") == F.col("x")).select("l_orderkey", "l_linenumber", "ecdf")


@query("W12 W14", """
SELECT user_id, event_id, (sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) / 5 AS smooth, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events""")
def smoothed(t: Tables) -> DataFrame:
    """A moving mean over a full window, edges padded with zeros, and a running sum."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_id", (F.sum("value").over(w.rowsBetween(-2, 2)) / 5).alias("smooth"), F.sum("value").over(w).alias("running"))


@query("W15", "WITH d AS (SELECT DISTINCT l_tax AS x FROM lineitem) SELECT (x + nx) / 2 AS cut FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM d) WHERE nx IS NOT NULL")
def threshold_midpoints(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_tax").alias("x")).distinct()
    return d.select("x", F.lead("x").over(Window.partitionBy(F.lit(1)).orderBy("x")).alias("nx")).where("nx IS NOT NULL").select(((F.col("x") + F.col("nx")) / 2).alias("cut"))


@query("F28 F24 F25 A45", """
SELECT p_partkey, (SELECT m FROM (SELECT unnest([1000, 2000, 5000, 10000, 20000, 30000, 50000, 100000, 200000]) AS m) ORDER BY abs(m - p_size * 1777), m LIMIT 1) AS magnification, exp(-abs(p_size - 25) / 10.0) AS weight, (abs(p_size - 25) / 14.0 + abs(p_retailprice - 1000) / 300.0) / 2 AS distance FROM part""")
def similarity_weights(t: Tables) -> DataFrame:
    from tesserae.functions import numeric

    s = F.col("p_size")
    return t.part.select("p_partkey", numeric.nearest_magnification(s * 1777).alias("magnification"), F.exp(-F.abs(s - 25) / 10.0).alias("weight"), ((F.abs(s - 25) / 14.0 + F.abs(F.col("p_retailprice") - 1000) / 300.0) / 2).alias("distance"))
