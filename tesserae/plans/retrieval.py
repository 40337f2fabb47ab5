"""Queries of ranking: BM25 over chunks, cosine neighbours, lexical and hybrid scores, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import blocks
from tesserae.operators import retrieval as R
from tesserae.operators.blocks import spread
from tesserae.plans.registry import Tables, query

STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z]+|[一-鿿]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))"
CHUNKED = """
ch AS (SELECT doc_id, k, substring(t, k * 420 + 1, 500) AS chunk FROM (
  SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 500) / 420.0)) AS BIGINT) + 1)) AS k
  FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) > 0))"""


def chunk_rows(t: Tables) -> DataFrame:
    """S-to-C: documents as overlapping chunks with an id (doc_id * 100000 + index)."""
    clean = spread(t.documents.select("doc_id", "text")).select("doc_id", text.squeeze(F.col("text")).alias("t"))
    return clean.select("doc_id", F.posexplode(text.chunks(F.col("t"))).alias("k", "chunk")).withColumn("id", F.col("doc_id") * 100000 + F.col("k"))


def query_terms(t: Tables) -> DataFrame:
    found = t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return found


BM25_SQL = f"""
WITH {CHUNKED},
q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS.format('text')}) AS term FROM benchmark),
tok AS (SELECT doc_id * 100000 + k AS id, {TOKENS.format('chunk')} AS ts FROM ch),
len AS (SELECT id, len(ts) AS n FROM tok),
size AS (SELECT count(*) AS n, avg(n) AS avgdl FROM len),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM tok) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, tf.id, sum(ln((size.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len.n / avgdl))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.id = tf.id, size GROUP BY qid, tf.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s)
"""


@query("F01 F02 F03 A35 F31 J18 K04 U-", BM25_SQL + "SELECT qid, id AS chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    """The ten best chunks for every benchmark item."""
    return best_chunks(t).select("qid", F.col("id").alias("chunk_id"), "score", "rank")


def best_chunks(t: Tables) -> DataFrame:
    return R.bm25_top(chunk_rows(t), "id", text.tokens(F.col("chunk")), query_terms(t), 10)


METRICS_SQL = BM25_SQL + """,
item AS (SELECT item_id AS qid, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
doc AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
irun AS (SELECT DISTINCT qid, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT qid, w, unnest(range(1, len(w) - 6)) AS i FROM item WHERE len(w) >= 8)),
drun AS (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)),
rel AS (SELECT DISTINCT qid, doc_id FROM irun JOIN drun USING (s)),
hit AS (SELECT r.qid, r.rank, r.id // 100000 AS doc_id FROM ranked r WHERE rank <= 10),
first AS (SELECT qid, doc_id, min(rank) AS rank FROM hit GROUP BY ALL),
marked AS (SELECT f.qid, f.rank, rel.doc_id IS NOT NULL AS good FROM first f LEFT JOIN rel USING (qid, doc_id)),
total AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
per AS (SELECT t.qid, n, coalesce(count(*) FILTER (WHERE good), 0) AS hits, min(rank) FILTER (WHERE good) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE good), 0) AS dcg FROM total t LEFT JOIN marked m USING (qid) GROUP BY t.qid, n),
told AS (SELECT qid, n AS relevant, round(hits / n, 6) AS recall_10, round(coalesce(1.0 / first, 0), 6) AS mrr_10,
       round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 10) AS BIGINT) + 1) x(i)), 6) AS ndcg_10
FROM per)"""


@query("E01 E02 E03 K04", METRICS_SQL + " SELECT * FROM told")
def ranking_metrics(t: Tables) -> DataFrame:
    """Recall, reciprocal rank and nDCG at 10 of documents holding eight words of an item in a row."""
    return metrics(chunk_hits(best_chunks(t)), relevant(t), 10)


def chunk_hits(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", "rank", F.floor(F.col("id") / 100000).alias("doc_id")).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))


@query("E04 E11", METRICS_SQL.replace(BM25_SQL, BM25_SQL + """,
hits2 AS (SELECT qid, id, count(*) AS score FROM q JOIN tf USING (term) GROUP BY qid, id),
plain AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits2)""") + """,
hitp AS (SELECT DISTINCT qid, id // 100000 AS doc_id, min(rank) AS rank FROM plain WHERE rank <= 10 GROUP BY ALL),
perp AS (SELECT t.qid, n, count(p.doc_id) AS hits, min(p.rank) AS first FROM total t LEFT JOIN (SELECT hitp.* FROM hitp JOIN rel USING (qid, doc_id)) p USING (qid) GROUP BY t.qid, n)
SELECT 'bm25' AS model, count(*) AS queries, round(avg(recall_10), 5) AS recall_10, round(avg(mrr_10), 5) AS mrr_10 FROM told
UNION ALL SELECT 'shared terms', count(*), round(avg(round(hits / n, 6)), 5), round(avg(round(coalesce(1.0 / first, 0), 6)), 5) FROM perp""")
def model_comparison(t: Tables) -> DataFrame:
    """Means over all queries of two rankings: BM25 and the number of shared terms."""
    good = relevant(t).persist()
    plain = R.shared_terms_top(chunk_rows(t), "id", text.tokens(F.col("chunk")), query_terms(t), 10)
    told = [metrics(chunk_hits(ranked), good, 10).withColumn("model", F.lit(model)) for model, ranked in (("bm25", best_chunks(t)), ("shared terms", plain))]
    return told[0].unionByName(told[1]).groupBy("model").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall_10"), 5).alias("recall_10"), F.round(F.avg("mrr_10"), 5).alias("mrr_10"))


def relevant(t: Tables) -> DataFrame:
    """(qid, doc_id): documents with eight words in a row from anywhere in an item. Hashes of runs
    meet first, eight bytes each; only runs whose hashes meet are compared as text."""
    run = lambda p: F.slice("w", p, 8)
    words = lambda df, key: df.select(F.col(key), F.split(text.squeeze(F.col("text")), " ").alias("w")).where(F.size("w") >= 8)
    runs = lambda df, key: df.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda p: F.struct(F.xxhash64(run(p)).alias("h"), p.alias("p")))).alias("r"), "w")
    items = runs(words(t.benchmark.withColumnRenamed("item_id", "qid"), "qid"), "qid").select("qid", "r.h", F.slice("w", F.col("r.p"), 8).alias("q")).distinct()
    docs = words(spread(t.documents.select("doc_id", "text")), "doc_id")
    known = docs.select("doc_id", "w", F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda p: F.xxhash64(run(p))).alias("hs"))
    met = known.select("doc_id", F.explode(F.arrays_zip("hs", F.sequence(F.lit(1), F.size("hs")).alias("p"))).alias("r")).select("doc_id", F.col("r.hs").alias("h"), F.col("r.p").alias("p"))
    met = met.join(items, "h").select("doc_id", "qid", "p", "q")
    return met.join(docs, "doc_id").where(F.slice("w", F.col("p"), 8) == F.col("q")).select("qid", "doc_id").distinct()


def metrics(ranked: DataFrame, good: DataFrame, k: int) -> DataFrame:
    """Ranked (qid, doc_id, rank) against good (qid, doc_id)."""
    total = good.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(good, ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = total.join(hits, "qid", "left")
    return out.select(
        "qid", F.col("n").alias("relevant"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall_10"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_10"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_10"),
    )


@query("F29 J17 J18 K04", """
WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> qid)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(t: Tables) -> DataFrame:
    """Five nearest neighbours of every twentieth vector against all rows, block by block."""
    e = spread(t.embeddings)
    found = blocks.nearest(blocks.packed(e, "vec_id", "embedding", "p"), blocks.packed(e.where("vec_id % 20 = 0"), "vec_id", "embedding", "q"), R.cosine_gap, 5)
    scored = found.select("qid", "id", (-F.col("value")).alias("score"))
    return R.top_k(scored, 5)


LEXICAL_SQL = f"""
WITH tok AS (SELECT doc_id, lang, source, list_distinct({TOKENS.format('text')}) AS ts, {TOKENS.format('text')} AS every FROM documents),
kw AS (SELECT doc_id, list(term ORDER BY n DESC, term)[1:20] AS words FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(every) AS term FROM tok) GROUP BY ALL) GROUP BY doc_id),
core AS (SELECT doc_id, max(quality) AS is_core FROM labels GROUP BY doc_id),
q AS (SELECT item_id AS qid, list_distinct({TOKENS.format('text')}) AS q FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT qid, tok.doc_id, 2.0 * len(list_intersect(q, ts)) + 3.0 * coalesce(len(list_intersect(q, words)), 0) + CASE WHEN is_core = 1 THEN 1.5 ELSE 0 END
  + CASE WHEN lang = 'en' THEN 4.0 ELSE 0 END + CASE WHEN lang IN ('en', 'de') THEN 2.5 ELSE 0 END - CASE WHEN lang IN ('es') THEN 2.0 ELSE 0 END AS score
  FROM tok LEFT JOIN kw USING (doc_id) LEFT JOIN core USING (doc_id), q)
"""


def lexical_scores(t: Tables) -> DataFrame:
    tokens = text.tokens(F.col("text"))
    documents = spread(t.documents)
    docs = documents.select("doc_id", "lang", F.array_distinct(tokens).alias("ts"))
    core = t.labels.groupBy("doc_id").agg(F.max("quality").alias("is_core"))
    q = t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.array_distinct(text.tokens(F.col("text"))).alias("q"))
    rows = docs.join(R.keywords(documents, "doc_id", tokens), "doc_id", "left").join(core, "doc_id", "left").crossJoin(q)  # a stated query set
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    return rows.select("qid", "doc_id", R.lexical(F.col("ts"), words, F.col("q"), F.col("is_core"), F.col("lang"), "en", ["en", "de"], ["es"]).alias("score"))


def keywords(t: Tables, top: int = 20) -> DataFrame:
    return R.keywords(spread(t.documents.select("doc_id", "text")), "doc_id", text.tokens(F.col("text")), top)


@query("F30 K03", LEXICAL_SQL + "SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 25")
def lexical_topk(t: Tables) -> DataFrame:
    """The best documents for every twentieth item by hits, core flag and theme preference."""
    scored = lexical_scores(t).where("score > 0").withColumn("score", F.round("score", 4))
    return R.top_k(scored, 25, tie="doc_id")


@query("A34 F03", f"""
WITH tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
n AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL)
SELECT doc_id, array_to_string(list(term ORDER BY n DESC, term)[1:20], ' ') AS keywords FROM n GROUP BY doc_id""")
def keywords_top20(t: Tables) -> DataFrame:
    return keywords(t).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("E06 U-", """
WITH s AS (SELECT l_suppkey AS qid, l_partkey AS id, sum(l_extendedprice) AS dense, sum(l_quantity) AS sparse FROM lineitem GROUP BY ALL),
n AS (SELECT qid, id, dense / max(dense) OVER (PARTITION BY qid) AS d, sparse / max(sparse) OVER (PARTITION BY qid) AS s FROM s)
SELECT qid, id, score, rank FROM (SELECT qid, id, round(0.6 * d + 0.4 * s, 8) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(0.6 * d + 0.4 * s, 8) DESC, id) AS rank FROM n) WHERE rank <= 3""")
def hybrid_normalised(t: Tables) -> DataFrame:
    """Two scores made comparable by their group's largest, 0.6 to 0.4."""
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("id")).agg(F.sum("l_extendedprice").alias("dense"), F.sum("l_quantity").alias("sparse"))
    score = 0.6 * R.normalised(F.col("dense"), "qid") + 0.4 * R.normalised(F.col("sparse"), "qid")
    return R.top_k(s.select("qid", "id", F.round(score, 8).alias("score")), 3)
