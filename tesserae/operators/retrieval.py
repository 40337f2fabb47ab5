"""Ranking of pieces of text: BM25, cosine, lexical and hybrid scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.blocks import best

K1, B = 1.5, 0.75


def term_counts(pieces: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf, length): one row a term of each piece."""
    length = F.size("ts").cast("long")
    return pieces.select(key, tokens.alias("ts")).select(key, length.alias("length"), F.explode("ts").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(pieces: DataFrame, key: str, tokens: Column, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, key, score) of pieces that share a term with a query.

    `queries` has (qid, term), each term once for a query. Terms of no query leave before the
    shuffle of counts: the semi join keeps what can match, and only matching rows meet.
    """
    counted = pieces.select(key, tokens.alias("ts")).select(key, F.size("ts").cast("long").alias("length"), "ts")
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    terms = counted.select(key, "length", F.explode("ts").alias("term")).join(queries.select("term").distinct(), "term", "left_semi")
    tf = terms.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = tf.join(df, "term").crossJoin(F.broadcast(size))  # one row of totals
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    return weighted.select(key, "term", score.alias("s")).join(queries, "term").groupBy("qid", key).agg(F.sum("s").alias("score"))


def bm25_top(pieces: DataFrame, key: str, tokens: Column, queries: DataFrame, k: int, digits: int = 6, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, key, score, rank): the k best pieces for each query by the score's
    `digits` decimals, ties by key.

    The terms of a stated query set are held by every task, up to `MOST` of them: pieces are then
    counted and scored where they are, and a task sends the best k of each query. Larger query sets
    are joined with the pieces' terms instead."""
    held = queries.select(F.col("qid").cast("long").alias("qid"), "term").distinct().limit(MOST + 1).collect()
    if len(held) > MOST:
        scored = bm25(pieces, key, tokens, queries, k1, b).withColumn("score", F.round("score", digits))
        return top_k(scored, k, tie=key)
    vocabulary, asked = sorted({r["term"] for r in held}), sorted({r["qid"] for r in held})
    code = {t: n for n, t in enumerate(vocabulary)}
    place = {q: n for n, q in enumerate(asked)}
    wants = np.array(sorted((code[r["term"]], place[r["qid"]]) for r in held), np.int64).reshape(-1, 2)
    sent = pieces.sparkSession.sparkContext.broadcast((vocabulary, np.array(asked, np.int64), wants))
    rows = pieces.select(F.col(key).cast("long").alias("key"), tokens.alias("ts"))
    counts = {r["code"]: r["n"] for r in rows.select("ts").mapInArrow(_term_statistics(sent), "code int, n double").groupBy("code").agg(F.sum("n").alias("n")).collect()}  # a row a term
    n, total = counts.get(-1, 0.0), counts.get(-2, 0.0)
    df = np.array([counts.get(c, 0.0) for c in range(len(vocabulary))])
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    found = rows.mapInArrow(_term_scores(sent, idf, total / max(n, 1), k, digits, k1, b), f"qid long, {key} long, score double")
    return top_k(found, k, tie=key)


MOST = 500_000  # terms of a query set that every task holds


def shared_terms_top(pieces: DataFrame, key: str, tokens: Column, queries: DataFrame, k: int) -> DataFrame:
    """The k pieces with most of a query's terms, ties by key: one join on terms."""
    terms = pieces.select(key, F.explode(F.array_distinct(tokens)).alias("term"))
    return top_k(terms.join(queries, "term").groupBy("qid", key).agg(F.count(F.lit(1)).alias("score")), k, tie=key)


def cosine_gap(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """cosines of all rows of two matrices, to six decimals and turned round, so that less is
    nearer; NaN for a zero vector."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return -np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (p / np.linalg.norm(p, axis=1)[:, None]).T, 6)


def _coded(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct known terms of each row: row, term's number and count; and the rows' lengths."""
    at = np.asarray(lists.offsets).astype(np.int64)
    length = np.diff(at)
    code = np.asarray(pc.fill_null(pc.index_in(lists.values.slice(at[0], at[-1] - at[0]), value_set=vocabulary), -1)).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    cell, tf = np.unique((row * len(vocabulary) + code)[code >= 0], return_counts=True)
    row, code = np.divmod(cell, max(len(vocabulary), 1))
    return row, code, tf, length


def _term_statistics(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(sent.value[0], pa.string())
        df, n, total = np.zeros(len(vocabulary)), 0, 0
        for b in it:
            _, code, _, length = _coded(b.column("ts"), vocabulary)
            df += np.bincount(code, minlength=len(vocabulary))
            n, total = n + len(length), total + int(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[some], [n, total]]))], names=["code", "n"])

    return run


def _term_scores(sent, idf: np.ndarray, average: float, k: int, digits: int, k1: float, b_: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, asked, wants = sent.value
        vocabulary = pa.array(terms, pa.string())
        first = np.searchsorted(wants[:, 0], np.arange(len(terms) + 1))
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]  # query, key, score
        size = max(1, min(4096, (1 << 21) // max(len(asked), 1)))
        for batch in it:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                keys = np.asarray(part.column("key"))
                row, code, tf, length = _coded(part.column("ts"), vocabulary)
                weight = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * length[row] / average))
                times = first[code + 1] - first[code]
                at = np.repeat(first[code] - np.concatenate([[0], np.cumsum(times)[:-1]]) if len(code) else first[:0], times) + np.arange(int(times.sum()))
                cell = wants[at, 1] * len(keys) + np.repeat(row, times)
                score = np.bincount(cell, weights=np.repeat(weight, times), minlength=len(asked) * len(keys)).reshape(len(asked), -1)
                q, p = best(np.where(score > 0, -np.round(score, digits), np.nan), keys, k)
                held.append((q, keys[p], np.round(score[q, p], digits)))
                if len(held) > 64:
                    held = [_kept(held, k)]
        q, keys, score = _kept(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(keys), pa.array(score)], names=["qid", "key", "score"])

    return run


def _kept(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, keys, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((keys, -score, q))
    q, keys, score = q[order], keys[order], score[order]
    few = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[few], keys[few], score[few]


def keywords(rows: DataFrame, key: str, tokens: Column, top: int = 20) -> DataFrame:
    """(key, keywords): the most frequent tokens of each row, ties by token, counted inside the row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                lists = part.column("ts")
                at = np.asarray(lists.offsets).astype(np.int64)
                coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
                order = pc.sort_indices(coded.dictionary)
                words, number = coded.dictionary.take(order), np.argsort(np.asarray(order))[np.asarray(coded.indices)]
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                cell, n = np.unique(row * max(len(words), 1) + number, return_counts=True)
                row, word = np.divmod(cell, max(len(words), 1))
                order = np.lexsort((word, -n, row))
                row, word = row[order], word[order]
                few = np.arange(len(row)) - np.searchsorted(row, row) < top
                ends = np.searchsorted(row[few], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(word[few])))], names=["k", "keywords"])

    return rows.select(F.col(key).alias("k"), tokens.alias("ts")).where(F.size("ts") > 0).mapInArrow(run, f"k {kind}, keywords array<string>").withColumnRenamed("k", key)


def top_k(scored: DataFrame, k: int, group: str | None = "qid", tie: str = "id", score: str = "score") -> DataFrame:
    """The k best of each group with their rank; ties by id."""
    order = [F.col(score).desc(), F.col(tie).asc()]
    window = Window.partitionBy(group).orderBy(*order) if group else Window.orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """of two float arrays, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def lexical(tokens: Column, keywords: Column, query: Column, is_core: Column, theme: Column, preferred: str, themes: list[str], discouraged: list[str]) -> Column:
    """hits in text and keywords, and what the task's profile prefers."""
    text_hits = F.size(F.array_intersect(query, tokens))
    word_hits = F.size(F.array_intersect(query, keywords))
    score = 2.0 * text_hits + 3.0 * word_hits + F.when(is_core == 1, 1.5).otherwise(0.0)
    score = score + F.when(theme == preferred, 4.0).otherwise(0.0) + F.when(theme.isin(themes), 2.5).otherwise(0.0)
    return score - F.when(theme.isin(discouraged), 2.0).otherwise(0.0)


def normalised(score: Column, group: str) -> Column:
    """By the group's largest score; 0 where that is 0."""
    top = F.max(score).over(Window.partitionBy(group))
    return F.when(top > 0, score / top).otherwise(0.0)


def exact_match(fields: list[Column], evidence: Column, query: str) -> Column:
    """boosts of links that name the query itself."""
    total = F.when(F.lower(evidence).contains(query), 0.8).otherwise(0.0)
    for f in fields:
        low = F.lower(F.coalesce(f, F.lit("")))
        total = total + F.when((low == query) | low.endswith(f":{query}"), 4.0).when(low.contains(query), 1.2).otherwise(0.0)
    return total
