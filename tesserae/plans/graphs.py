"""Queries of evidence graphs: links are line items between suppliers' nations, customers' nations and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import graph as G
from tesserae.plans.registry import Tables, query

LINKS = """
links AS (
  SELECT l_orderkey * 10 + l_linenumber AS id,
    CASE WHEN l_returnflag = 'A' THEN 'process_mechanism' WHEN l_returnflag = 'R' THEN 'process_morphology' WHEN l_linenumber % 2 = 0 THEN 'morphology_performance' ELSE 'mechanism_morphology' END AS relation,
    CASE WHEN l_returnflag IN ('A', 'R') THEN 'process:' || l_suppkey WHEN l_linenumber % 2 = 0 THEN 'morphology:' || (l_partkey % 25) ELSE 'mechanism:' || l_partkey END AS source,
    CASE WHEN l_returnflag = 'A' THEN 'mechanism:' || l_partkey WHEN l_returnflag = 'R' OR l_linenumber % 2 = 1 THEN 'morphology:' || (l_partkey % 25) ELSE 'performance:' || (l_suppkey % 7) END AS target,
    CASE WHEN l_linestatus = 'O' THEN 'increase' ELSE 'decrease' END AS direction, round(l_discount * 8 + 0.15, 4) AS confidence
  FROM lineitem)"""


def links(t: Tables) -> DataFrame:
    """A link for each line item, as LINKS says it."""
    return t.lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "CASE WHEN l_returnflag = 'A' THEN 'process_mechanism' WHEN l_returnflag = 'R' THEN 'process_morphology' WHEN l_linenumber % 2 = 0 THEN 'morphology_performance' ELSE 'mechanism_morphology' END AS relation",
        "CASE WHEN l_returnflag IN ('A', 'R') THEN concat('process:', l_suppkey) WHEN l_linenumber % 2 = 0 THEN concat('morphology:', l_partkey % 25) ELSE concat('mechanism:', l_partkey) END AS source",
        "CASE WHEN l_returnflag = 'A' THEN concat('mechanism:', l_partkey) WHEN l_returnflag = 'R' OR l_linenumber % 2 = 1 THEN concat('morphology:', l_partkey % 25) ELSE concat('performance:', l_suppkey % 7) END AS target",
        "CASE WHEN l_linestatus = 'O' THEN 'increase' ELSE 'decrease' END AS direction", "round(l_discount * 8 + 0.15, 4) AS confidence",
    )


@query("A33", f"WITH {LINKS} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM links UNION ALL SELECT target FROM links) GROUP BY node")
def degree_counts(t: Tables) -> DataFrame:
    return G.degrees(links(t))


@query("J14", f"""WITH {LINKS}, e AS (SELECT source AS a, target AS b FROM links WHERE relation <> 'process_morphology' AND confidence > 0.7 UNION SELECT target, source FROM links WHERE relation <> 'process_morphology' AND confidence > 0.7),
h0 AS (SELECT 'process:1' AS node), h1 AS (SELECT DISTINCT b AS node FROM h0 JOIN e ON a = node WHERE b NOT IN (SELECT node FROM h0)), h2 AS (SELECT DISTINCT b AS node FROM h1 JOIN e ON a = node WHERE b NOT IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def subgraph(t: Tables) -> DataFrame:
    seeds = t.spark.createDataFrame([("process:1",)], "node string")
    return G.expand(links(t).where("confidence > 0.7"), seeds, 2, ["process_mechanism", "mechanism_morphology"])


@query("J16", f"""WITH {LINKS}, w AS (SELECT source AS a, target AS b, confidence AS c FROM links UNION ALL SELECT target, source, confidence FROM links), m AS (SELECT a, b, max(c) AS c FROM w WHERE a <> b GROUP BY 1, 2),
near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM m QUALIFY n <= 3), p1 AS (SELECT DISTINCT source AS node, [source] AS path FROM links WHERE relation = 'process_mechanism'),
p2 AS (SELECT node, CASE WHEN b IS NULL THEN path ELSE list_append(path, b) END AS path FROM p1 LEFT JOIN near ON a = path[len(path)] AND n = 1),
p3 AS (SELECT node, any_value(path) AS path, arg_min(b, n) AS b FROM p2 LEFT JOIN near ON a = path[len(path)] AND NOT list_contains(path, b) GROUP BY node)
SELECT node, array_to_string(CASE WHEN b IS NULL THEN path ELSE list_append(path, b) END, '>') AS path FROM p3""")
def greedy_paths(t: Tables) -> DataFrame:
    """From each process the path that always goes to the best neighbour it hasn't visited."""
    ln = links(t)
    seeds = ln.where("relation = 'process_mechanism'").select(F.col("source").alias("node")).distinct()
    return G.greedy_paths(ln, seeds, 3).select("node", F.array_join("path", ">").alias("path"))


@query("J12 J13 K03", f"""WITH {LINKS}, g AS (SELECT * FROM links WHERE confidence >= 0.6), s AS (SELECT source AS head, target AS tail, arg_max(id, (confidence, -id)) AS s_id, max(confidence) AS s_conf FROM g WHERE relation = 'process_morphology' GROUP BY 1, 2)
SELECT a.id AS a_id, b.id AS b_id, s_id, a.source AS head, a.target AS mid, b.target AS tail, round((a.confidence + b.confidence) / 2 + coalesce(0.1 * s_conf, 0), 6) AS score
FROM g a JOIN g b ON a.relation = 'process_mechanism' AND b.relation = 'mechanism_morphology' AND a.target = b.source LEFT JOIN s ON s.head = a.source AND s.tail = b.target
ORDER BY score DESC, a_id, b_id LIMIT 200""")
def chain_two_hops(t: Tables) -> DataFrame:
    c = G.chains(links(t), "process_mechanism", "mechanism_morphology", "process_morphology", 0.6).withColumn("score", F.round("score", 6))
    return c.orderBy(F.desc("score"), "a_id", "b_id").limit(200).select("a_id", "b_id", "s_id", "head", "mid", "tail", "score")


PATHS = f"""WITH {LINKS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, id) AS n FROM links) WHERE n <= 20),
seed AS (SELECT * FROM links WHERE relation = 'process_mechanism' AND confidence >= 0.8),
p AS (SELECT [id] AS ids, 1 AS n, confidence AS c, direction AS d, source AS head, target AS tail, CASE WHEN direction = 'increase' THEN 1.0 ELSE 0 END AS w, source || target AS nodes FROM seed
 UNION ALL SELECT [s.id, f.id], 2, (s.confidence + f.confidence) / 2, s.direction, s.source, f.target, (CASE WHEN s.direction = 'increase' THEN 1.0 ELSE 0 END + CASE WHEN f.direction = 'increase' THEN 1.0 ELSE 0 END) / 2, s.source || ' ' || s.target || ' ' || f.source || ' ' || f.target FROM seed s JOIN f ON f.source = s.target AND f.id <> s.id),
sc AS (SELECT *, round(w * 0.3 + c * 0.3 + 0.2 + 0.2 * (CASE WHEN contains(nodes, 'mechanism:1') THEN 0.5 ELSE 0 END + CASE WHEN contains(nodes, 'morphology:2') THEN 0.5 ELSE 0 END), 6) AS score FROM p)"""


def scored_paths(ln: DataFrame) -> DataFrame:
    seeds = ln.where("relation = 'process_mechanism' AND confidence >= 0.8")
    paths = G.grow(ln, seeds, 1)
    s = paths.select("path", *G.path_scores(F.col("path"), ["mechanism:1", "morphology:2"], "increase"))
    return s.withColumn("score", F.round("score", 6)).withColumn("ids", F.array_join(F.transform("path", lambda p: p["id"].cast("string")), "-"))


@query("J15 F34 F35", PATHS + " SELECT array_to_string(ids, '-') AS ids, score FROM sc")
def path_scores(t: Tables) -> DataFrame:
    return scored_paths(links(t)).select("ids", "score")


@query("J15 A41 K07", PATHS + """, m AS (SELECT d FROM p GROUP BY d ORDER BY count(*) DESC, d LIMIT 1), x AS (SELECT max(score) AS top FROM sc),
k AS (SELECT array_to_string(ids, '-') AS ids, score, CASE WHEN sc.d <> m.d THEN 'conflicting' WHEN score >= top * 0.7 AND n >= 2 THEN 'primary' ELSE 'supporting' END AS chain_type FROM sc, m, x)
SELECT ids, score, chain_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY chain_type ORDER BY score DESC, ids) AS rank FROM k) WHERE rank <= CASE chain_type WHEN 'primary' THEN 3 WHEN 'supporting' THEN 5 ELSE 3 END""")
def chain_classes(t: Tables) -> DataFrame:
    """Three primary, five supporting and three conflicting chains."""
    c = G.quota(G.classify(scored_paths(links(t))), {"primary": 3, "supporting": 5, "conflicting": 3}, F.col("ids"))
    return c.select("ids", "score", "chain_type", "rank")


ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in G.TRANSITIONS)


@query("J15", f"""WITH {LINKS}, ok(first, next) AS (VALUES {ALLOWED}), f AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, id) <= 20),
p1 AS (SELECT id AS i1, source AS head, target AS tail, relation, confidence AS c FROM links WHERE relation = 'process_mechanism' AND confidence >= 0.9),
p2 AS (SELECT i1, f.id AS i2, head, f.target AS tail, f.relation, f.confidence AS c FROM p1 JOIN f ON f.source = p1.tail AND f.id <> i1 JOIN ok ON first = p1.relation AND next = f.relation),
p3 AS (SELECT head, f.target AS tail, f.confidence AS c FROM p2 JOIN f ON f.source = p2.tail AND f.id <> i1 AND f.id <> i2 JOIN ok ON first = p2.relation AND next = f.relation)
SELECT length, head, tail, count(*) AS n, round(max(c), 4) AS best FROM (SELECT 1 AS length, head, tail, c FROM p1 UNION ALL SELECT 2, head, tail, c FROM p2 UNION ALL SELECT 3, head, tail, c FROM p3) GROUP BY 1, 2, 3""")
def path_three_hops(t: Tables) -> DataFrame:
    """Paths along allowed transitions of up to three links, counted by length and ends."""
    allowed = t.spark.createDataFrame(G.TRANSITIONS, "first string, then string")
    ln = links(t)
    paths = G.grow(ln, ln.where("relation = 'process_mechanism' AND confidence >= 0.9"), 2, transitions=allowed)
    return paths.groupBy(F.size("path").alias("length"), F.element_at("path", 1)["source"].alias("head"), F.element_at("path", -1)["target"].alias("tail")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.element_at("path", -1)["confidence"]), 4).alias("best"))


@query("K08 D07", PATHS.replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT head, ids, score, row_number() OVER (PARTITION BY head ORDER BY score DESC, array_to_string(ids, '-') DESC) AS r FROM sc),
walk AS (SELECT DISTINCT head, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[][]) AS taken, CAST([] AS DOUBLE[]) AS scores FROM c
 UNION ALL SELECT head, r, CASE WHEN ok THEN list_append(taken, ids) ELSE taken END, CASE WHEN ok THEN list_append(scores, score) ELSE scores END
 FROM (SELECT w.head, c.r, w.taken, w.scores, c.ids, c.score, coalesce(list_max(list_transform(w.taken, lambda x: len(list_intersect(c.ids, x)) / len(c.ids))), 0) <= 0.6 AS ok FROM walk w JOIN c ON c.head = w.head AND c.r = w.r + 1 WHERE len(w.taken) < 5)),
done AS (SELECT head, arg_max(taken, r) AS taken, arg_max(scores, r) AS scores FROM walk GROUP BY head)
SELECT head, CAST(i AS INT) AS rank, array_to_string(taken[i], '-') AS id, scores[i] AS score FROM (SELECT head, taken, scores, unnest(range(1, len(taken) + 1)) AS i FROM done)""")
def suppressed_paths(t: Tables) -> DataFrame:
    """Of each head the five best paths of which no better one has more than 60 % of the links."""
    p = scored_paths(links(t)).select(F.element_at("path", 1)["source"].alias("head"), F.col("ids").alias("id"), F.split("ids", "-").alias("members"), "score")
    return G.suppress(p, "head", "members", "score", 5)


@query("A32 A45 E13", f"WITH {LINKS} SELECT relation, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, round(avg(confidence), 6) AS mean, CASE WHEN avg(confidence) >= 0.7 THEN 'high' WHEN avg(confidence) >= 0.4 THEN 'medium' ELSE 'low' END AS level, round(count(DISTINCT direction) * 1.0 / count(*), 8) AS variety FROM links GROUP BY relation")
def evidence_integration(t: Tables) -> DataFrame:
    mean = F.avg("confidence")
    return links(t).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"), F.round(mean, 6).alias("mean"), F.when(mean >= 0.7, "high").when(mean >= 0.4, "medium").otherwise("low").alias("level"), F.round(F.countDistinct("direction") / F.count(F.lit(1)), 8).alias("variety"))


@query("F32 F33", f"WITH {LINKS} SELECT id, round(s * (0.7 + least(confidence, 1) * 0.3), 6) AS profile, boost FROM (SELECT id, confidence, CASE WHEN relation = 'process_mechanism' THEN 1.0 ELSE 0 END + CASE WHEN source IN ('process:1', 'process:2') THEN 0.7 ELSE 0 END + CASE WHEN target LIKE '%:7' THEN 0.8 ELSE 0 END AS s, CASE WHEN source LIKE '%:7' THEN 4.0 WHEN contains(source, '7') THEN 1.2 ELSE 0 END + CASE WHEN target LIKE '%:7' THEN 4.0 WHEN contains(target, '7') THEN 1.2 ELSE 0 END + CASE WHEN contains(relation, '7') THEN 0.8 ELSE 0 END AS boost FROM links) WHERE s > 0 OR boost > 0")
def link_scores(t: Tables) -> DataFrame:
    """Links against a query's profile, and boosts for naming the query itself."""
    from tesserae.operators.retrieval import exact_match

    s = F.when(F.col("relation") == "process_mechanism", 1.0).otherwise(0.0) + F.when(F.col("source").isin("process:1", "process:2"), 0.7).otherwise(0.0) + F.when(F.col("target").endswith(":7"), 0.8).otherwise(0.0)
    out = links(t).select("id", "confidence", s.alias("s"), exact_match([F.col("source"), F.col("target")], F.col("relation"), "7").alias("boost")).where("s > 0 OR boost > 0")
    return out.select("id", F.round(F.col("s") * (0.7 + F.least("confidence", F.lit(1.0)) * 0.3), 6).alias("profile"), "boost")
