"""Queries of the catalogue: names parsed, rows filtered, sorted, paged, deduplicated, upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import calibration, numeric, parsing, text
from tesserae.operators import catalog as C
from tesserae.plans.registry import Tables, query

LISTED = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS source, l_quantity AS temp, l_discount, l_linestatus, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_deleted, p_name, p_brand, p_type, l_extendedprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey"


def listed(t: Tables) -> DataFrame:
    """Measurement rows: line items with their parts; an open line counts as deleted."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("temp"), "l_discount", "l_linestatus", F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_deleted"), "p_name", "p_brand", "p_type", F.col("l_extendedprice").alias("price"))


def listing(t: Tables, source: str | None = None, least: float | None = None, most: float | None = None, needle: str | None = None, view: str = "active") -> DataFrame:
    rows = listed(t)
    return rows.where(
        C.conjunction(
            C.visible(rows, view), F.col("source") == source if source else None, F.col("temp") >= least if least is not None else None,
            F.col("temp") <= most if most is not None else None, C.contains_any(needle, "p_name", "p_brand", "p_type") if needle else None,
        )
    )


@query("P05 P06 P07 J01 S01", f"WITH x AS ({LISTED}) SELECT id, source, temp, p_name FROM x WHERE is_deleted = 0 AND source = 'R' AND temp BETWEEN 10 AND 30 AND (p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%')")
def listing_filter(t: Tables) -> DataFrame:
    return listing(t, "R", 10, 30, "a").select("id", "source", "temp", "p_name")


@query("K01 K02", f"WITH x AS ({LISTED}) SELECT id, price, (SELECT count(*) FROM x WHERE is_deleted = 0 AND source = 'A') AS total FROM x WHERE is_deleted = 0 AND source = 'A' ORDER BY price DESC, id LIMIT 50 OFFSET 100")
def listing_paged(t: Tables) -> DataFrame:
    """A page in a listed order, with the number of rows of all pages."""
    rows = listing(t, "A")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = C.page(rows.select("id", "price"), C.order({"price": "price"}, "price"), 50, 100)
    return top.crossJoin(F.broadcast(total))  # one row


@query("P06 A01", f"WITH x AS ({LISTED}) SELECT source, count(*) AS n, count(*) FILTER (WHERE is_deleted = 1) AS deleted, count(*) FILTER (WHERE l_discount > 0.05) AS processed FROM x GROUP BY source")
def summary_counts(t: Tables) -> DataFrame:
    return listed(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_deleted") == 1).alias("deleted"), F.count_if(F.col("l_discount") > 0.05).alias("processed"))


def names(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr("concat('No', p_partkey, ' 200w 40nm 30w 1.', p_size % 10, 'nm 500 100 ', p_size, ' 700 7', p_size % 50 + 10, ' 15min 3h ', CASE p_size % 4 WHEN 0 THEN 'mid' WHEN 1 THEN 'Top' WHEN 2 THEN 'bpttom' ELSE '' END, ' ', CASE WHEN p_size % 3 = 0 THEN '5000' ELSE '50000' END, '-', p_partkey % 7, '.tif')").alias("name"))


@query("P01 P04 P12 F22 F23", """
WITH n AS (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'mid' WHEN 1 THEN 'Top' WHEN 2 THEN 'bottom' ELSE 'Unknown' END AS place, CASE WHEN p_size % 3 = 0 THEN 5000 ELSE 50000 END AS m FROM part)
SELECT p_partkey AS id, 'No' || p_partkey || '-' || m || '-' || (p_partkey % 7) AS sample_id, 1 + (p_size % 10) / 10.0 AS fe_thickness, CAST(p_size AS DOUBLE) AS c2h4_flow, CAST(710 + p_size % 50 AS DOUBLE) AS growth_temp,
       0.25 AS anneal_h, 3.0 AS growth_h, place AS position_label, CAST(m AS BIGINT) AS magnification, place = 'mid' AND m >= 9000 AS importable FROM n""")
def parsed_names(t: Tables) -> DataFrame:
    n = names(t).withColumn("f", parsing.long_name(F.col("name")))
    return n.select("id", "f.sample_id", "f.fe_thickness", "f.c2h4_flow", "f.growth_temp", numeric.hours(F.col("f.anneal_time")).alias("anneal_h"), numeric.hours(F.col("f.growth_time")).alias("growth_h"), "f.position_label", "f.magnification", parsing.importable(F.col("f.position_label"), F.col("f.magnification")).alias("importable"))


PATHS = "SELECT p_partkey AS id, (240101 + p_partkey % 28) || ' T' || (750 + p_size) || ' ' || (p_size % 5 + 1) || 'H L' || (100 + p_size) || CASE WHEN p_size % 2 = 0 THEN ' 0.' || (p_size % 9 + 1) || 'g' ELSE '' END AS folder, 'C' || (p_size % 10 + 1) || substr('ABC', p_size % 3 + 1, 1) || (p_partkey % 5) || '.tiff' AS file FROM part"


def paths(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr("concat(240101 + p_partkey % 28, ' T', 750 + p_size, ' ', p_size % 5 + 1, 'H L', 100 + p_size, CASE WHEN p_size % 2 = 0 THEN concat(' 0.', p_size % 9 + 1, 'g') ELSE '' END)").alias("folder"), F.expr("concat('C', p_size % 10 + 1, substr('ABC', p_size % 3 + 1, 1), p_partkey % 5, '.tiff')").alias("file"))


@query("P02 P03 F19 S11", f"""
WITH p AS ({PATHS}) SELECT id, 'C' || regexp_extract(file, 'C(\\d+)', 1) || '-' || regexp_extract(file, 'C\\d+([ABC]\\d+)', 1) AS sample_id, CAST(regexp_extract(file, 'C(\\d+)', 1) AS BIGINT) AS membrane_id,
  CAST(regexp_extract(folder, 'T(\\d+)', 1) AS DOUBLE) AS growth_temp, CAST(regexp_extract(folder, 'L(\\d+)', 1) AS DOUBLE) AS ar_flow,
  coalesce(TRY_CAST(nullif(regexp_extract(folder, '(\\d+(?:\\.\\d+)?)\\s*g', 1), '') AS DOUBLE), 1.0) AS catalyst_weight, CAST(regexp_extract(folder, '(\\d+)H', 1) AS BIGINT) AS time_h,
  CAST(strptime('20' || regexp_extract(folder, '^(\\d{{6}})', 1), '%Y%m%d') AS DATE) AS day FROM p""")
def parsed_paths(t: Tables) -> DataFrame:
    p = paths(t).withColumn("s", parsing.short_name(F.col("file"), F.col("folder"))).withColumn("f", parsing.folder_name(F.col("folder")))
    return p.select("id", "s.sample_id", "s.membrane_id", "s.growth_temp", "s.ar_flow", "s.catalyst_weight", "f.time_h", parsing.experiment_date(F.col("folder")).alias("day"))


def _profile_sql(x: str, s: str) -> str:
    """The profiles as SQL, from the same coefficients."""
    curve = {}
    for temp, points in calibration.PROFILES.items():
        parts = calibration.spline(*points)
        cases = " ".join(f"WHEN {x} >= {x0!r} THEN {c0!r} + ({x} - {x0!r}) * ({c1!r} + ({x} - {x0!r}) * ({c2!r} + ({x} - {x0!r}) * {c3!r}))" for x0, c0, c1, c2, c3 in reversed(parts[1:]))
        x0, c0, c1, c2, c3 = parts[0]
        curve[temp] = f"(CASE {cases} ELSE {c0!r} + ({x} - {x0!r}) * ({c1!r} + ({x} - {x0!r}) * ({c2!r} + ({x} - {x0!r}) * {c3!r})) END)"
    return f"CASE WHEN {s} <= 750 THEN {curve[750]} WHEN {s} <= 800 THEN {curve[750]} + ({curve[800]} - {curve[750]}) * ({s} - 750) / 50.0 WHEN {s} <= 850 THEN {curve[800]} + ({curve[850]} - {curve[800]}) * ({s} - 800) / 50.0 ELSE {curve[850]} END"


@query("F26 F27 S11", f"WITH p AS (SELECT p_partkey AS id, 740.0 + p_size * 3 AS s, CAST(p_size % 10 AS DOUBLE) * (41.2 / 9) AS x FROM part) SELECT id, round(x, 6) AS cm, round({_profile_sql('x', 's')}, 6) AS actual_temp FROM p")
def calibrated(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), (740.0 + F.col("p_size") * 3).cast("double").alias("s"), calibration.membrane_cm(F.col("p_size") % 10 + 1).alias("x"))
    return p.select("id", F.round("x", 6).alias("cm"), F.round(calibration.actual_temp(F.col("s"), F.col("x")), 6).alias("actual_temp"))


TOKENS = "CASE event_id % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN ' n/a ' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE CAST(value AS VARCHAR) END"


@query("P10 P11 F20", f"WITH e AS (SELECT event_id, {TOKENS} AS v, event_id % 7 > 3 AS num, value FROM events) SELECT event_id, CASE WHEN num THEN value END AS v FROM e")
def tolerant_cast(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 > 3, F.col("value").cast("string")).otherwise(F.element_at(F.array(F.lit("NaN"), F.lit(" n/a "), F.lit(""), F.lit("abc")), F.least(F.col("event_id") % 7, F.lit(3)).cast("int") + 1))
    return t.events.select("event_id", numeric.number(raw).alias("v"))


@query("P13 P14 P15", """
SELECT CASE WHEN l_quantity <= 5 THEN 'low' WHEN l_quantity <= 20 THEN 'mid' ELSE 'high' END AS power, CASE WHEN l_discount >= 0.08 THEN 'A' WHEN l_discount >= 0.06 THEN 'B' WHEN l_discount >= 0.04 THEN 'C' ELSE 'D' END AS band,
 CASE WHEN l_tax = 0.08 AND l_returnflag = 'N' THEN 'high' WHEN l_tax = 0.04 AND l_returnflag = 'R' THEN 'mid' WHEN l_tax = 0.02 AND l_returnflag = 'A' THEN 'low' ELSE 'other' END AS gas, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL""")
def case_bands(t: Tables) -> DataFrame:
    gas = F.when((F.col("l_tax") == 0.08) & (F.col("l_returnflag") == "N"), "high").when((F.col("l_tax") == 0.04) & (F.col("l_returnflag") == "R"), "mid").when((F.col("l_tax") == 0.02) & (F.col("l_returnflag") == "A"), "low").otherwise("other")
    power = numeric.band(F.col("l_quantity"), [(5, "low"), (20, "mid")], "high", low=True)
    level = numeric.band(F.col("l_discount"), [(0.08, "A"), (0.06, "B"), (0.04, "C")], "D")
    return t.lineitem.groupBy(power.alias("power"), level.alias("band"), gas.alias("gas")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("P08 P09", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber IN (1, 2, 3) AND l_tax IS NOT NULL AND l_discount IS NOT NULL AND l_quantity = 17")
def controlled_subset(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity = 17").where(F.col("l_linenumber").isin(1, 2, 3)).dropna(subset=["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("P16 P17 P20", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '15min' WHEN 'N' THEN '30min' WHEN 'R' THEN '1h' END || '_' || l_linestatus AS combo, l_quantity * l_discount AS xy, l_quantity * l_quantity AS xx, l_linenumber * l_tax AS it,
 CASE WHEN l_discount <> 0 THEN l_tax / l_discount * 100 END AS ratio FROM lineitem""")
def derived_features(t: Tables) -> DataFrame:
    label = F.element_at(F.create_map(F.lit("A"), F.lit("15min"), F.lit("N"), F.lit("30min"), F.lit("R"), F.lit("1h")), F.col("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.concat_ws("_", label, "l_linestatus").alias("combo"), (F.col("l_quantity") * F.col("l_discount")).alias("xy"), (F.col("l_quantity") * F.col("l_quantity")).alias("xx"), (F.col("l_linenumber") * F.col("l_tax")).alias("it"), numeric.ratio(F.col("l_tax"), F.col("l_discount"), 100).alias("ratio"))


@query("P18", """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN 700.0 + p_size END AS t, CASE WHEN p_size % 7 > 0 THEN p_size * 10.0 END AS ar, CASE WHEN p_size % 3 > 0 THEN p_size * 2.0 END AS h2, CASE WHEN p_size % 4 > 0 THEN p_size - 10.0 END AS c, p_size / 20.0 AS w, CASE WHEN p_size % 2 > 0 THEN p_size * 1.0 END AS x FROM part),
d AS (SELECT id, coalesce(t, 750) AS t, coalesce(ar, 500) AS ar, coalesce(h2, 100) AS h2, coalesce(c, 50) AS c, w, coalesce(x, 18) AS x FROM p)
SELECT id, t / 750 AS temp_normalized, ar + h2 + c AS gas_total, CASE WHEN ar > 0 THEN c / ar ELSE 0 END AS carbon_supply, CASE WHEN ar > 0 THEN h2 / ar ELSE 0 END AS reduction_ratio, CASE WHEN c > 0 THEN ar / c ELSE 0 END AS ar_to_c2h4_ratio,
 x / 36 AS position_normalized, t * w AS temp_x_catalyst, ar * (t / 800) AS flow_temp_interaction, ar / greatest(w, 0.1) AS flow_per_catalyst FROM d""")
def enhanced_features(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("double")
    some = lambda k, v: F.when(F.col("p_size") % k > 0, v)
    return t.part.select(F.col("p_partkey").alias("id"), *numeric.enhanced_features(some(5, 700 + s), some(7, s * 10), some(3, s * 2), some(4, s - 10), s / 20, some(2, s)))


@query("P19 P22 P23 A42", """
WITH p AS (SELECT p_partkey AS id, 550.0 + p_size * 9 AS t, p_size / 12.0 AS fe, p_size * 20.0 AS ar, CASE WHEN p_size % 10 > 0 THEN p_size % 10 * 5.0 END AS c FROM part),
v AS (SELECT unnest(list_filter([CASE WHEN t < 600 THEN 'temperature_low' END, CASE WHEN t > 900 THEN 'temperature_high' END, CASE WHEN fe < 0.5 THEN 'fe_thin' END, CASE WHEN fe > 3 THEN 'fe_thick' END, CASE WHEN ar / c < 5 THEN 'gas_ratio_low' END, CASE WHEN ar / c > 50 THEN 'gas_ratio_high' END], lambda x: x IS NOT NULL)) AS kind FROM p)
SELECT kind, count(*) AS n FROM v GROUP BY kind ORDER BY n DESC, kind LIMIT 20""")
def constraint_violations(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("double")
    c = F.when(F.col("p_size") % 10 > 0, F.col("p_size") % 10 * 5.0)
    kinds = t.part.select(F.explode(numeric.violations(550 + s * 9, s / 12, s * 20, c)).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(20)


@query("P21 B15", """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS d, l_discount * 10 - 0.2 AS a, l_quantity * 5 AS di, l_tax * 500 AS c, CASE WHEN l_linenumber <> 6 THEN 0.9 + l_discount * 20 END AS t, l_tax * 30 AS w, l_partkey % 5 * 10000 AS m FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, greatest(0, 100 - CASE WHEN d IS NULL THEN 35 WHEN d <= 0 OR d > 95 THEN 40 WHEN d < 5 OR d > 85 THEN 18 ELSE 0 END - CASE WHEN a IS NULL THEN 20 WHEN a < -0.5 OR a > 1 THEN 30 WHEN a < 0 THEN 12 ELSE 0 END
 - CASE WHEN di IS NULL THEN 15 WHEN di < 5 OR di > 200 THEN 30 WHEN di > 120 THEN 12 ELSE 0 END - CASE WHEN c IS NULL THEN 18 WHEN c < 0 OR c > 100 THEN 28 WHEN c > 30 THEN 10 ELSE 0 END - CASE WHEN t IS NULL THEN 10 WHEN t < 1 OR t > 3 THEN 25 WHEN t > 2.2 THEN 10 ELSE 0 END
 - CASE WHEN w IS NULL THEN 8 WHEN w < 0 OR w > 5 THEN 20 WHEN w > 2 THEN 10 ELSE 0 END - CASE WHEN m < 20000 THEN 14 ELSE 0 END) AS score FROM x)
SELECT CASE WHEN score < 55 THEN 'low' WHEN score < 80 THEN 'medium' ELSE 'high' END AS confidence, score, count(*) AS n FROM s GROUP BY ALL""")
def quality_scores(t: Tables) -> DataFrame:
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    score = numeric.quality_score(F.when(F.col("l_linenumber") != 7, q * 2), d * 10 - 0.2, q * 5, x * 500, F.when(F.col("l_linenumber") != 6, 0.9 + d * 20), x * 30, F.col("l_partkey") % 5 * 10000)
    s = t.lineitem.select(score.alias("score"))
    return s.groupBy(numeric.quality_band(F.col("score")).alias("confidence"), "score").agg(F.count(F.lit(1)).alias("n"))


@query("P24 P25 P26 P28 F21", """
WITH e AS (SELECT event_id, event_type || ':' || user_id AS node, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, split_part(node, ':', 1) AS category, split_part(node, ':', 2) AS label, CASE split_part(node, ':', 1) WHEN 'view' THEN 'process' WHEN 'click' THEN 'mechanism' WHEN 'purchase' THEN 'performance' ELSE split_part(node, ':', 1) END AS translated, k, substr(node, 1, strpos(node, ':') + 1) AS prefix FROM e""")
def entity_labels(t: Tables) -> DataFrame:
    """Nodes split, renamed by a small mapping table with fall-through, and JSON read."""
    e = t.events.select("event_id", F.concat_ws(":", "event_type", "user_id").alias("node"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    mapping = t.spark.createDataFrame([("view", "process"), ("click", "mechanism"), ("purchase", "performance")], "old string, new string")
    e = e.withColumn("category", text.category(F.col("node"))).withColumn("label", text.suffix(F.col("node")))
    e = e.join(F.broadcast(mapping), F.col("category") == F.col("old"), "left")  # three rows
    return e.select("event_id", "category", "label", F.coalesce("new", "category").alias("translated"), "k", F.expr("substring(node, 1, instr(node, ':') + 1)").alias("prefix"))


@query("P27 P30 F05", """
SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'applications' WHEN contains(lower(text), 'der') THEN 'characterization' WHEN contains(lower(text), 'que') THEN 'growth' ELSE 'general' END AS theme,
 CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END AS level FROM documents WHERE lang NOT IN ('unknown', 'N/A')""")
def themes(t: Tables) -> DataFrame:
    """Ordered rules from text to theme, and an ordinal code of a label."""
    low = F.lower("text")
    theme = F.when(low.contains("the"), "applications").when(low.contains("der"), "characterization").when(low.contains("que"), "growth").otherwise("general")
    level = F.coalesce(F.element_at(F.create_map(F.lit("en"), F.lit(3), F.lit("de"), F.lit(2), F.lit("fr"), F.lit(1)), F.col("lang")), F.lit(0))
    return t.documents.where(~F.col("lang").isin("unknown", "N/A")).select("doc_id", theme.alias("theme"), level.alias("level"))


@query("P29", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey = o_orderkey THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || ',' || o_orderkey END AS ids FROM orders")
def batch_ids(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("x"), F.lit(""))).otherwise(F.array(F.col("o_custkey").cast("string"), F.lit("bad"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")))
    return t.orders.select("o_orderkey", F.array_join(C.valid_ids(raw).cast("array<string>"), ",").alias("ids"))


@query("D03 D08 D11 W03", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def dedup_keep_best(t: Tables) -> DataFrame:
    best = C.best_per(t.lineitem, ["l_partkey", "l_suppkey", "l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return best.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("D02 D04 W08", "SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def dedup_signature(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).dropDuplicates()


@query("D05", """
WITH c AS (SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'doi:' || (user_id // 3) ELSE 'title:' || event_type || (user_id % 11) END AS key, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS r, event_type || user_id AS title, CASE WHEN event_id % 4 > 0 THEN 2000 + event_id % 20 END AS year, event_type AS tag, 'u' || (user_id % 5) AS note FROM events)
SELECT key, max(r) AS rank, arg_max(title, (length(title), -id)) AS title, arg_min(year, id) FILTER (WHERE year IS NOT NULL) AS year, string_agg(DISTINCT tag, ';' ORDER BY tag) AS tags, string_agg(DISTINCT note, ' | ' ORDER BY note) AS notes, count(*) AS n FROM c GROUP BY key""")
def entity_merge(t: Tables) -> DataFrame:
    c = t.events.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("doi:"), F.floor(F.col("user_id") / 3))).otherwise(F.concat(F.lit("title:"), "event_type", F.col("user_id") % 11)).alias("key"), F.expr("CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END").alias("r"), F.concat("event_type", "user_id").alias("title"), F.when(F.col("event_id") % 4 > 0, 2000 + F.col("event_id") % 20).alias("year"), F.col("event_type").alias("tag"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("note"))
    return C.resolve(c, F.col("key"), F.col("r")).withColumnRenamed("_key", "key")


@query("D06 S19 J08", """
WITH old AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice * 2 END AS o_totalprice, upper(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def upsert_merge(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice", "o_orderpriority")
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") * 2).alias("o_totalprice"), F.upper("o_orderpriority").alias("o_orderpriority"))
    return C.upsert(old, new, "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query("D06 S11", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def insert_or_ignore(t: Tables) -> DataFrame:
    old = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return C.insert_missing(old, t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name")), "c_custkey")


@query("D01", "SELECT 'orders' AS origin, o_orderkey AS key, o_totalprice AS amount, NULL AS name FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_name FROM customer")
def concat_frames(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    b = t.customer.select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("D07 E05", """
WITH a AS (SELECT l_suppkey AS q, list(DISTINCT l_partkey) AS got FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS q, list(DISTINCT l_partkey) AS want FROM lineitem WHERE l_discount > 0.05 GROUP BY 1),
c AS (SELECT q, len(list_intersect(got, want)) AS common, len(got) AS g, len(want) AS w FROM a JOIN b USING (q))
SELECT q, common, round(common / g, 6) AS precision, round(common / w, 6) AS recall, CASE WHEN common > 0 THEN round(2.0 * common / (g + w), 6) ELSE 0 END AS f1 FROM c""")
def f1_sets(t: Tables) -> DataFrame:
    """Precision, recall and F1 of sets, from counts: no set is collected."""
    got = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("x")).distinct().withColumn("g", F.lit(1))
    want = t.lineitem.where("l_discount > 0.05").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("x")).distinct().withColumn("w", F.lit(1))
    c = got.join(want, ["q", "x"], "full_outer").groupBy("q").agg(F.count(F.col("g") + F.col("w")).alias("common"), F.count("g").alias("g"), F.count("w").alias("w")).where("g > 0 AND w > 0")
    f1 = F.when(F.col("common") > 0, F.round(2.0 * F.col("common") / (F.col("g") + F.col("w")), 6)).otherwise(0.0)
    return c.select("q", "common", F.round(F.col("common") / F.col("g"), 6).alias("precision"), F.round(F.col("common") / F.col("w"), 6).alias("recall"), f1.alias("f1"))


@query("D09", "WITH u AS (SELECT doc_id, source, CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 10000 / 10000.0 AS u FROM documents) SELECT doc_id, source, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS part FROM u")
def grouped_split(t: Tables) -> DataFrame:
    """Whole groups to train, val and test; no source is in two parts."""
    return C.split_by_group(t.documents.select("doc_id", "source"), "source")


@query("W16", """
WITH g AS (SELECT l_returnflag || l_linestatus || l_linenumber AS g, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT g, n, n * 100.0 / sum(n) OVER () AS share FROM g),
f AS (SELECT g, n, floor(share) AS base, share - floor(share) AS frac FROM s), r AS (SELECT *, row_number() OVER (ORDER BY round(frac, 9) DESC, g) AS rn, 100 - sum(base) OVER () AS rest FROM f)
SELECT g, n, CAST(base + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r""")
def apportion(t: Tables) -> DataFrame:
    """Largest-remainder shares of 100 over a few groups."""
    from pyspark.sql import Window

    g = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    f = g.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * 100.0 / F.col("all")).withColumn("base", F.floor("share"))  # one row
    rest = 100 - F.sum("base").over(Window.partitionBy(F.lit(1)))
    rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round(F.col("share") - F.col("base"), 9).desc(), "g"))
    return f.select("g", "n", (F.col("base") + F.when(rn <= rest, 1).otherwise(0)).cast("long").alias("seats"))


@query("W17", """
WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), e AS (SELECT event_id, event_type, CAST(floor(n * 0.5) AS BIGINT) AS a, CAST(floor(n * 0.3) AS BIGINT) AS b, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events JOIN g USING (event_type))
SELECT event_id, CASE WHEN i >= a + b THEN 'reserve' WHEN i < 2 * b AND i % 2 = 1 THEN 'test' ELSE 'train' END AS part FROM e""")
def alternating_split(t: Tables) -> DataFrame:
    """Events of each kind by turns to train and test, half and three tenths of them, the rest in reserve."""
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = t.events.join(n, "event_type")
    return C.alternate(rows, ["event_type"], [F.asc("event_id")], F.floor(F.col("n") * 0.5), F.floor(F.col("n") * 0.3)).select("event_id", "part")


@query("K10", "SELECT l_suppkey, first.l_orderkey AS l_orderkey, first.l_linenumber AS l_linenumber FROM (SELECT l_suppkey, max({'a': l_discount, 'b': -l_tax, 'c': l_quantity, 'l_orderkey': -l_orderkey, 'l_linenumber': -l_linenumber}) AS m FROM lineitem GROUP BY 1) x, LATERAL (SELECT -m.l_orderkey AS l_orderkey, -m.l_linenumber AS l_linenumber) first")
def weighted_ties(t: Tables) -> DataFrame:
    """The best row of each group by several measures in turn, as the largest struct."""
    best = F.max(F.struct("l_discount", (-F.col("l_tax")).alias("t"), "l_quantity", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))).alias("m")
    return t.lineitem.groupBy("l_suppkey").agg(best).select("l_suppkey", (-F.col("m.o")).alias("l_orderkey"), (-F.col("m.n")).alias("l_linenumber"))


@query("S02 S01", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def sql_frames(t: Tables) -> DataFrame:
    """SQL text over named tables, its frames bound by name without global views."""
    return t.spark.sql("SELECT r_name, count(*) AS n FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name", customer=t.customer, nation=t.nation, region=t.region)
