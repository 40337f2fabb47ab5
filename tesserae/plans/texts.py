"""Queries of text: chunks, sentences, factors, relations, conditions, normalisation, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import statements, text
from tesserae.operators import graph as G
from tesserae.operators.blocks import spread
from tesserae.plans.registry import Tables, query
from tesserae.plans.retrieval import CHUNKED, chunk_rows

# The test texts hold invented words; these stand in for the domain's.
def _word(w: str) -> str:
    """A word between other than Latin letters, alike in every dialect of patterns."""
    return f"(?:^|[^a-zà-ÿ]){w}(?:$|[^a-zà-ÿ])"


LEXICON = {"process": {"heat": [_word("the")], "flow": [_word("der"), _word("de")]}, "morphology": {"shape": [_word("on")], "size": [_word("in")]}, "performance": {"conductivity": [_word("with")], "resistivity": [_word("by")]}, "mechanism": {"diffusion": [_word("from")]}}
UP, DOWN = [_word("and")], [_word("of")]


@query("F01 F02 W18 A06", f"WITH {CHUNKED} SELECT doc_id, count(*) AS n, sum(length(chunk)) AS chars, md5(string_agg(chunk, '|' ORDER BY k)) AS digest FROM ch GROUP BY doc_id")
def chunk_texts(t: Tables) -> DataFrame:
    c = chunk_rows(t)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "chunk"))), lambda x: x["chunk"]), "|")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).alias("chars"), F.md5(joined).alias("digest"))


@query("F04", "WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?;\\n]+'), lambda x: trim(x, ' \t\r\n')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


HIT = {k: {x: "|".join(p) for x, p in v.items()} for k, v in LEXICON.items()}


def _hits(kind: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{x}' END" for x, p in HIT[kind].items()) + "], lambda x: x IS NOT NULL)"


SENTENCES = f"""
s0 AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?;\\n]+'), lambda x: trim(x, ' \t\r\n')), lambda x: x <> '')) AS s FROM documents),
s1 AS (SELECT doc_id, s, lower(s) AS low FROM s0),
s2 AS (SELECT doc_id, {", ".join(f"{_hits(k)} AS {k}" for k in HIT)}, CASE WHEN regexp_matches(low, '{UP[0]}') AND regexp_matches(low, '{DOWN[0]}') THEN 'nonlinear_or_tradeoff' WHEN regexp_matches(low, '{UP[0]}') THEN 'increase' WHEN regexp_matches(low, '{DOWN[0]}') THEN 'decrease' END AS direction FROM s1)"""


@query("F05 F06 P27", f"WITH {SENTENCES} SELECT coalesce(direction, 'none') AS direction, array_to_string(process, ',') AS process, array_to_string(morphology, ',') AS morphology, count(*) AS n FROM s2 GROUP BY ALL")
def factor_hits(t: Tables) -> DataFrame:
    s = spread(t.documents.select("text")).select(F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy(F.coalesce(text.direction(F.col("s"), UP, DOWN), F.lit("none")).alias("direction"), F.array_join(text.factors(F.col("s"), LEXICON["process"]), ",").alias("process"), F.array_join(text.factors(F.col("s"), LEXICON["morphology"]), ",").alias("morphology")).agg(F.count(F.lit(1)).alias("n"))


def _pair(relation: str, a: str, b: str, more: float) -> str:
    return f"SELECT doc_id, '{relation}' AS relation, '{a}:' || x AS source, '{b}:' || y AS target, direction, least(base + {more}, 0.95) AS confidence FROM (SELECT doc_id, direction, base, unnest({a}) AS x, {b} AS ys FROM s3), unnest(ys) AS u(y)"


@query("U01 U02 U05 W08 D04", f"""WITH {SENTENCES}, s3 AS (SELECT *, len(mechanism) > 0 AS known, CASE WHEN len(mechanism) > 0 THEN 0.65 ELSE 0.55 END AS base FROM s2 WHERE direction IS NOT NULL),
l AS ({" UNION ALL ".join(_pair(*k) for k in G._KINDS)} UNION ALL SELECT doc_id, 'mechanism_evidence', 'mechanism:' || mechanism[1], 'evidence:literature', direction, 0.75 FROM s3 WHERE known AND len(process) + len(morphology) + len(performance) > 0),
d AS (SELECT DISTINCT doc_id, relation, source, 'performance:conductivity' AS target, CASE direction WHEN 'increase' THEN 'decrease' WHEN 'decrease' THEN 'increase' ELSE direction END AS direction FROM l WHERE target = 'performance:resistivity'),
n AS (SELECT * FROM d ANTI JOIN l USING (doc_id, relation, source, target, direction))
SELECT relation, source, target, direction, count(*) AS n FROM (SELECT doc_id, relation, source, target, direction FROM l UNION ALL SELECT doc_id, relation, source, target, direction FROM n) GROUP BY ALL""")
def relation_links(t: Tables) -> DataFrame:
    """Links of all sentences of all documents, with the derived inverse ones, counted."""
    r = G.valid_facts(G.relations(spread(t.documents.select("doc_id", "text")), "doc_id", "text", LEXICON, UP, DOWN, []))
    return r.groupBy("relation", "source", "target", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("F13 A02", "SELECT CASE WHEN h <> '' THEN regexp_replace(h, '^www\\.', '') ELSE 'local_page' END AS domain, count(*) AS n FROM (SELECT regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h FROM pages) GROUP BY 1 ORDER BY n DESC, domain LIMIT 12")
def domain_counts(t: Tables) -> DataFrame:
    d = t.pages.select(text.domain(F.col("url"), F.lit("page")).alias("domain"))
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(12)


@query("F14 F15", """
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || lower(regexp_extract(url, '//([^/?#]*)', 1)) || regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '') AS url_key,
 substr(sha1(url), 1, 10) AS digest, trim(substr(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') AS slug FROM pages""")
def normalised_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.url_key(F.col("url")).alias("url_key"), text.fingerprint(F.col("url")).alias("digest"), text.slug(F.col("url")).alias("slug"))


STATED = "'At temperature above ' || (700 + p_size) || ' and flow between ' || p_size || ' and ' || (p_size + 50) || ', thickness > ' || (p_size / 10.0) || ' nm, 10-' || (10 + p_size) || ' min.'"


@query("F07 F08 F39", f"""
WITH s AS (SELECT p_partkey, p_size FROM part)
SELECT p_partkey, 'temperature' AS parameter, '>' AS op, 700.0 + p_size AS lo, NULL AS hi, '°C' AS unit, 720 > 700 + p_size AS holds FROM s
UNION ALL SELECT p_partkey, 'thickness', '>', p_size / 10.0, NULL, 'nm', 720 > p_size / 10.0 FROM s
UNION ALL SELECT p_partkey, 'time', 'in_range', 10.0, 10.0 + p_size, 'min', 720 BETWEEN 10 AND 10 + p_size FROM s
UNION ALL SELECT p_partkey, 'flow', 'in_range', p_size, p_size + 50.0, 'sccm', 720 BETWEEN p_size AND p_size + 50 FROM s""")
def stated_conditions(t: Tables) -> DataFrame:
    """Numeric conditions read from sentences, and whether a value of 720 meets them."""
    s = F.concat(F.lit("At temperature above "), 700 + F.col("p_size"), F.lit(" and flow between "), F.col("p_size"), F.lit(" and "), F.col("p_size") + 50, F.lit(", thickness > "), F.col("p_size") / 10, F.lit(" nm, 10-"), 10 + F.col("p_size"), F.lit(" min."))
    c = t.part.select("p_partkey", F.explode(text.conditions(s)).alias("c")).select("p_partkey", "c.*")
    return c.withColumn("holds", text.condition_holds(F.col("op"), F.col("lo"), F.col("hi"), F.lit(720.0)))


@query("F16 F17 B11", None)
def cleaned_scans(t: Tables) -> DataFrame:
    """Cleaned text and what looked wrong with it, in figures; the patterns need back references."""
    clean = text.clean_scan(F.col("text"), {"teh": "the"})
    return t.documents.select("doc_id", F.length(clean).alias("n_clean"), F.md5(clean).alias("digest"), F.array_join(text.problems(F.col("text"), ["teh"]), ",").alias("problems"))


@query("F18 P21", "SELECT doc_id, round(least(1.0, length(text) / 1000.0) * 0.5 + CASE WHEN length(text) > 0 THEN 0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) ELSE 0 END, 6) AS score FROM documents")
def text_quality(t: Tables) -> DataFrame:
    """Length and the share of letters."""
    n = F.length("text")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return t.documents.select("doc_id", F.round(F.least(F.lit(1.0), n / 1000.0) * 0.5 + F.when(n > 0, 0.5 * letters / n).otherwise(0.0), 6).alias("score"))


@query("F38", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"')) AS links FROM pages")
def page_sections(t: Tables) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return t.pages.select("page_id", count("<p>").alias("paragraphs"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), count('href="').alias("links"))


@query("F21", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS out FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_columns(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", F.from_json("props", "k int").alias("p")).where("p.k IS NOT NULL")
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))).alias("out"))


@query("F09 F10 F11 U06", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'process_morphology' ELSE 'process_performance' END AS relation, CASE p_size % 3 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE 'nonlinear_or_tradeoff' END AS direction,
 CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.9 END AS confidence FROM part""")
def fact_links(t: Tables) -> DataFrame:
    """Facts with inferred relation, canonical direction and confidence."""
    s = t.part.select("p_partkey", F.concat(F.lit("process:"), "p_brand").alias("source"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("morphology:"), "p_type")).otherwise(F.concat(F.lit("performance:"), "p_type")).alias("target"), F.when(F.col("p_size") % 3 == 0, "positive").when(F.col("p_size") % 3 == 1, "inhibit").otherwise("unclear").alias("way"), F.concat("p_name", F.lit(" at "), "p_size", F.lit(" nm")).alias("sentence"))
    return s.select("p_partkey", *G.fact_to_link(F.col("source"), F.col("target"), F.col("way")), G.confidence_of(F.col("sentence"), F.lit(0.1), F.col("p_partkey") % 2 == 0, F.lit(True), F.lit(False)).alias("confidence")).withColumn("confidence", F.round("confidence", 6))


@query("F12 F05 F06 F07", """
SELECT p_partkey, 'growth_temp' AS process, CASE WHEN p_size % 2 = 0 THEN 'alignment' ELSE '' END AS morphology, CASE WHEN p_size % 2 = 1 THEN 'conductivity' ELSE '' END AS performance, 'diffusion' AS mechanism,
 CASE WHEN p_size % 2 = 0 THEN 'increase' ELSE 'decrease' END AS direction, 600.0 + p_size AS least, CASE WHEN p_size % 2 = 0 THEN 'process_morphology' ELSE 'process_performance' END AS relation FROM part""")
def parsed_queries(t: Tables) -> DataFrame:
    """Questions as entities, direction, numeric conditions and wanted relations, for a table of questions."""
    asked = t.part.select("p_partkey", F.concat(F.lit("Does a temperature above "), 600 + F.col("p_size"), F.when(F.col("p_size") % 2 == 0, " increase alignment").otherwise(" reduce conductivity"), F.lit(" by diffusion?")).alias("q"))
    found = {k: text.factors(F.col("q"), v) for k, v in (("process", G.PROCESS), ("morphology", G.MORPHOLOGY), ("performance", G.PERFORMANCE), ("mechanism", G.MECHANISM))}
    parsed = asked.select("p_partkey", *[F.array_join(c, ",").alias(k) for k, c in found.items()], text.direction(F.col("q"), G.INCREASE, G.DECREASE).alias("direction"), F.get(text.conditions(F.col("q")), 0)["lo"].alias("least"))
    target = F.when(F.col("morphology") != "", "morphology").when(F.col("performance") != "", "performance").otherwise("mechanism")
    return parsed.withColumn("relation", F.concat(F.when(F.col("process") != "", "process_").otherwise("mechanism_"), target))


# Statements of one thing acting on another: name, pattern with source and target, source bonus. Fixed patterns.
STATEMENTS = [
    ("nominalization", r"(?i)\b(?:increase|rise) in (\w+) (?:leads to|causes) (?:an? )?(?:increase|rise|drop) in (\w+)", 0.15),
    ("passive", r"(?i)\b(\w+) is (?:improved|increased|reduced|affected) by (\w+)", 0.10),
    ("negation", r"(?i)\b(\w+) does not (?:affect|change|improve) (\w+)", 0.10),
    ("plain", r"(?i)\b(\w+) (?:improves|increases|reduces|affects) (\w+(?: and \w+)?)", 0.0),
]


def stated_facts(sentences: DataFrame, key: str, column: str) -> DataFrame:
    """Facts of sentences by patterns; targets joined by `and` give a fact each."""
    parts = None
    for name, pattern, bonus in STATEMENTS:
        a, b = (F.regexp_extract(column, pattern, i) for i in (1, 2))
        source, target = (b, a) if name == "passive" else (a, b)
        s = sentences.where(F.col(column).rlike(pattern)).select(key, F.col(column).alias("s"), F.lit(name).alias("pattern"), F.lit(bonus).alias("bonus"), F.lower(source).alias("source"), F.explode(F.split(F.lower(target), " and ")).alias("target"))
        parts = s if parts is None else parts.unionByName(s)
    good = parts.where((F.col("source") != F.col("target")) & (F.length("source") >= 3) & (F.length("target") >= 3) & ~F.col("target").rlike(r"^\d+$"))
    score = G.confidence_of(F.col("s"), F.col("bonus"), F.size(text.conditions(F.col("s"))) > 0, F.lit(False), F.col("pattern") == "negation")
    return good.select(key, "pattern", "source", "target", (F.col("pattern") == "negation").alias("negated"), F.round(score, 6).alias("confidence"))


@query("U03 F10 F11", """
WITH s AS (SELECT p_partkey, p_size, 'brand' || p_size AS w FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'nominalization' WHEN 1 THEN 'passive' WHEN 2 THEN 'negation' ELSE 'plain' END AS pattern, w AS source, tg AS target, p_size % 4 = 2 AS negated,
 CAST(CASE p_size % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 ELSE 0.7 END AS DOUBLE) AS confidence
FROM s, (SELECT unnest(['density', 'alignment', 'height']) AS tg) WHERE CASE p_size % 4 WHEN 0 THEN tg = 'density' WHEN 1 THEN tg = 'alignment' WHEN 2 THEN tg = 'height' ELSE tg IN ('density', 'height') END""")
def rule_facts(t: Tables) -> DataFrame:
    w = F.concat(F.lit("brand"), F.col("p_size"))
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Increase in "), w, F.lit(" leads to an increase in density"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("alignment is improved by "), w)).when(F.col("p_size") % 4 == 2, F.concat(w, F.lit(" does not affect height at 10 nm"))).otherwise(F.concat(w, F.lit(" improves density and height")))
    return stated_facts(t.part.select("p_partkey", said.alias("said")), "p_partkey", "said")


FORMS = [
    "'brand' || p_size || ' increases the density of forests.'", "'Increase in flow ' || p_size || ' leads to taller tubes; more'", "'Alignment is improved by ' || p_name || '.'",
    "'Heat enhances growth and reduces ' || p_type || '!'", "'Pressure reduces height and ' || p_type", "'Higher power ' || p_size || ' results in better order.'",
    "'The ' || p_name || ' does not affect height'", "'when temperature > ' || (700 + p_size) || ', alignment improves'", "'with catalyst ' || p_size || ', yield is improved'", "'density 随着 温度' || p_size || ' 增加'", "'nothing is said of ' || p_name",
]
SAID = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(FORMS)) + " END"
_FOUND = [(k, form, relation, direction, pattern.replace("'", "''"), g["src"], g[end]) for k, (form, relation, direction, pattern) in enumerate(statements.PATTERNS) for g in (statements.places(pattern),) for end in ("tgt", "tgt2") if end in g]


@query("U04", f"WITH s AS (SELECT p_partkey, {SAID} AS s FROM part), f AS (" + " UNION ALL ".join(f"SELECT p_partkey, {n} AS n, '{form}' AS form, trim(regexp_extract(s, '(?i){p}', {a})) AS source, trim(regexp_extract(s, '(?i){p}', {b})) AS target, '{relation}' AS relation, '{direction}' AS direction FROM s WHERE regexp_matches(s, '(?i){p}')" for n, (_, form, relation, direction, p, a, b) in enumerate(_FOUND)) + """),
u AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, source, target, relation ORDER BY n) AS r FROM f WHERE source <> '' AND target <> '')
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY n) - 1 AS INT) AS place, form, source, target, relation, direction, form = 'negation' AS negated FROM u WHERE r = 1""")
def enhanced_facts(t: Tables) -> DataFrame:
    """Facts of sentences in ten forms by all patterns, and of one that states nothing."""
    said = t.part.select("p_partkey", F.expr(SAID).alias("said"))
    return statements.facts(said, "p_partkey", "said")
