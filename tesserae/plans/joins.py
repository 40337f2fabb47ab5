"""Queries of joins: latest versions, counts with zeros, anti and semi joins, aligned streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import parsing
from tesserae.operators import catalog as C
from tesserae.plans.registry import Tables, query


@query("J02 J03 J19 W04 P07", """
WITH latest AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)
SELECT c_custkey, n_name, r_name, o_orderkey, coalesce(price, c_acctbal) AS amount FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN latest ON o_custkey = c_custkey""")
def latest_target_left_join(t: Tables) -> DataFrame:
    """Latest version per key by one aggregation, then left joins: no correlated subquery."""
    latest = C.latest(t.orders, "o_custkey", "o_orderkey", "o_totalprice")
    out = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", "o_orderkey", F.coalesce("o_totalprice", "c_acctbal").alias("amount"))


@query("J04 A01", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def counts_with_zeros(t: Tables) -> DataFrame:
    """Counted before the join, so only one row a key meets the left side."""
    n = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t.customer.select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("J05", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 0")
def zero_fact_rows(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J06 J20", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT DISTINCT doc_id FROM labels)")
def not_in_rows(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("J07 A02", """
WITH seed AS (SELECT s_nationkey AS n FROM supplier WHERE s_suppkey <= 3), e AS (SELECT l_orderkey, l_linenumber, s_nationkey AS a, c_nationkey AS b, l_discount AS conf FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT DISTINCT l_orderkey, l_linenumber, a, b, conf FROM e WHERE (a IN (SELECT n FROM seed) OR b IN (SELECT n FROM seed)) AND a <> b ORDER BY conf DESC, l_orderkey, l_linenumber, a, b LIMIT 50""")
def semi_or_union(t: Tables) -> DataFrame:
    """Rows that touch a seed on either side: two semi joins instead of a join on OR."""
    seed = t.supplier.where("s_suppkey <= 3").select(F.col("s_nationkey").alias("n")).distinct()
    e = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    e = e.select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("l_discount").alias("conf")).where("a <> b")
    hit = e.join(seed, e["a"] == seed["n"], "left_semi").unionByName(e.join(seed, e["b"] == seed["n"], "left_semi")).distinct()
    return hit.orderBy(F.desc("conf"), "l_orderkey", "l_linenumber", "a", "b").limit(50)


@query("J09 A11", "SELECT l_orderkey, l_linenumber, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_partkey, l_suppkey) AS d, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem")
def group_back(t: Tables) -> DataFrame:
    """Group statistics beside each row, by one window instead of an aggregation and a join."""
    w = Window.partitionBy("l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - F.avg("l_extendedprice").over(w)).alias("d"), F.count(F.lit(1)).over(w).alias("n"))


@query("J10", """
WITH e AS (SELECT user_id, event_id AS id, 'img' || event_id AS name, event_id % 5 = 0 AS gone, event_id % 10 = 0 OR event_type = 'error' AND user_id % 7 = 0 AS absent, user_id % 7 = 0 AND event_type = 'error' AND event_id % 5 <> 0 AS bad FROM events),
f AS (SELECT *, min(CASE WHEN bad THEN id END) OVER (PARTITION BY user_id) AS first FROM e)
SELECT user_id, id, CASE WHEN NOT absent AND (first IS NULL OR id < first) THEN id END AS other, name, CASE WHEN id = first THEN 'failed' WHEN id > first THEN 'open' WHEN absent THEN 'skipped' ELSE 'paired' END AS status FROM f
UNION ALL SELECT user_id, NULL, id, name, 'open' FROM f WHERE NOT absent AND id > first""")
def ordered_alignment(t: Tables) -> DataFrame:
    """Images of a run against its summary, in order: summaries lack every tenth image, which is
    deleted, and, for some runs, images that aren't, from which on nothing pairs."""
    images = t.events.select("user_id", "event_id", F.concat(F.lit("IMG"), "event_id").alias("name"), (F.col("event_id") % 5 == 0).alias("is_deleted"), "event_type")
    absent = (F.col("event_id") % 10 == 0) | ((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0))
    summary = images.where(~absent).select("user_id", "event_id", F.lower("name").alias("name"))
    return C.aligned(images, summary, "user_id", "event_id", "name", "is_deleted")


@query("J21", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 10 = 0 AND (q.p_name = part.p_name OR (q.p_brand = part.p_brand AND q.p_size = part.p_size)))")
def anti_signature(t: Tables) -> DataFrame:
    """Rows none of whose signatures is known: signatures exploded, one equi anti join."""
    signed = t.part.select("p_partkey", "p_name", F.array(F.concat(F.lit("name:"), "p_name"), F.concat_ws(":", F.lit("kind"), "p_brand", "p_size")).alias("s"))
    known = signed.where("p_partkey % 10 = 0").select(F.explode("s").alias("k")).distinct()
    hit = signed.select("p_partkey", F.explode("s").alias("k")).join(known, "k", "left_semi").select("p_partkey").distinct()
    return signed.join(hit, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("J11 F22 F23", "SELECT page_id, regexp_extract(url, '([^/?#]+)$', 1) AS leaf FROM pages WHERE regexp_extract(url, '([^/?#]+)$', 1) <> ''")
def path_leaf(t: Tables) -> DataFrame:
    leaf = F.regexp_extract("url", "([^/?#]+)$", 1)
    return t.pages.select("page_id", leaf.alias("leaf")).where("leaf <> ''")


@query("J22 J23 W03 E11", """
WITH a AS (SELECT l_partkey AS k, max(l_discount) AS now FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_discount) AS was FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), c AS (SELECT l_partkey AS k, max(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT k, now, was, tax, now - was AS delta FROM a JOIN b USING (k) JOIN c USING (k)""")
def compared_results(t: Tables) -> DataFrame:
    """Best values with and without a setting, side by side, from one pass over the rows."""
    best = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_discount"))).alias("now"), F.max(F.when(F.col("l_returnflag") == "N", F.col("l_discount"))).alias("was"), F.max("l_tax").alias("tax"))
    return best.where("now IS NOT NULL AND was IS NOT NULL").withColumn("delta", F.col("now") - F.col("was"))


@query("J11 F22 P23", "SELECT p_size AS size, count(*) FILTER (WHERE p_partkey % 4 <> 0) AS found, count(*) FILTER (WHERE p_partkey % 4 = 0) AS missed FROM part GROUP BY p_size")
def stem_lookup(t: Tables) -> DataFrame:
    """File paths looked up by normalised stem in a table that lacks every fourth: found and missed."""
    paths = t.part.select("p_size", F.concat(F.lit("/data/run 1/no "), "p_partkey", F.lit(" mid.TIF")).alias("path"))
    table = t.part.where("p_partkey % 4 <> 0").select(F.concat(F.lit("no_"), "p_partkey", F.lit("_mid")).alias("k"), F.lit(1).alias("there"))
    met = paths.join(table, F.regexp_replace(parsing.stem(F.col("path")), " ", "_") == F.col("k"), "left")
    return met.groupBy(F.col("p_size").alias("size")).agg(F.count("there").alias("found"), F.count_if(F.col("there").isNull()).alias("missed"))
