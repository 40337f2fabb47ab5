"""Operators on literal rows: listings, ranks, graphs, metrics, sources, streams."""

from __future__ import annotations

import json
import math
import subprocess
import sys
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import catalog, evaluate, graph, images, predict, retrieval, stats
from tesserae.plans import registry
from tesserae.plans import retrieval as ranking
from tesserae.sources import files
from tesserae.streaming import ingest


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_visibility_and_paging(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, 1, 2.0), (3, 0, 3.0)], "id long, is_deleted int, t double")
    ids = lambda view: sorted(r.id for r in df.where(catalog.visible(df, view)).collect())
    assert ids("active") == [1, 3] and ids("deleted") == [2] and ids("all") == [1, 2, 3]
    bare = df.drop("is_deleted")
    assert bare.where(catalog.visible(bare, "deleted")).count() == 0 and bare.where(catalog.visible(bare)).count() == 3
    sort = catalog.order({"t": "t"}, "t", "desc")
    assert [r.id for r in catalog.page(df, sort, 2, 1).collect()] == [3, 2]
    assert [r.id for r in catalog.page(df, catalog.order({"t": "t"}, "evil; drop"), 9, 0).collect()] == [3, 2, 1]


def test_latest_upsert_and_insert(spark):
    versions = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k long, v long, x string")
    assert sorted(rows(catalog.latest(versions, "k", "v", "x"))) == [(1, 3, "c"), (2, 1, None)]
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, x string, y double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", None), (3, "c", None)], "k long, x string, y double")
    assert sorted(rows(catalog.upsert(old, new.dropDuplicates(), "k", ["x", "y"]))) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", None)]
    assert sorted(r.k for r in catalog.insert_missing(old, new, "k").collect()) == [1, 2, 3]


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (10.0, 20.0, 20.0, 30.0, None)], "g string, v double")
    ranked = stats.with_rank(stats.with_rank(df, "v", ["g"], "a"), "v", ["g"], "b", False, percent=True)
    got = rows(ranked.select("v", "a", "b").orderBy("v"))
    assert got == [(None, None, None), (10.0, 1.0, 1.0), (20.0, 2.5, 0.625), (20.0, 2.5, 0.625), (30.0, 4.0, 0.25)]


def test_correlation_of_awkward_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    r = df.agg(stats.pearson(F.col("a"), F.col("b")), stats.pearson(F.col("a"), F.col("c")), stats.pearson(F.col("a"), F.col("b"), 3)).first()
    assert r[0] == pytest.approx(1.0) and r[1] is None and r[2] is None


def test_least_squares_fallbacks(spark):
    make = lambda data: spark.createDataFrame(data, "x double, z double, y double")
    assert stats.least_squares(make([(None, 1.0, 1.0)]), ["x", "z"], "y") == ("none", 0, [0.0, 0.0, 0.0])
    assert stats.least_squares(make([(1.0, 1.0, 4.0), (2.0, 1.0, 6.0)]), ["x", "z"], "y") == ("mean", 2, [5.0, 0.0, 0.0])
    data = [(float(i), float(i * i % 7), 2 + 3.0 * i - (i * i % 7)) for i in range(12)]
    method, n, c = stats.least_squares(make(data), ["x", "z"], "y")
    assert (method, n) == ("ols", 12) and np.allclose(c, [2, 3, -1])


def test_noise_weights_have_mean_one(spark):
    df = spark.createDataFrame([(i % 6, float(i * i % 11)) for i in range(50)], "k long, y double")
    w = stats.noise_weights(df, ["k"], "y").collect()
    assert sum(r.weight for r in w) / len(w) == pytest.approx(1.0)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5)], "p double")
    got = {r.p: round(r.q, 6) for r in stats.benjamini_hochberg(df).collect()}
    assert got == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5}


def test_perfect_ranking_scores_one(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)], "qid long, doc_id long, rank int")
    good = spark.createDataFrame([(1, 10), (1, 11), (2, 21), (3, 30)], "qid long, doc_id long")
    got = {r.qid: (r.recall_10, r.mrr_10, r.ndcg_10) for r in ranking.metrics(ranked, good, 10).collect()}
    assert got[1] == (1.0, 1.0, 1.0) and got[3] == (0.0, 0.0, 0.0)
    assert got[2] == (1.0, 0.5, round(1 / math.log2(3), 6))


def test_bm25_prefers_rare_terms(spark):
    pieces = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, ["a", "c", "c"])], "id long, ts array<string>")
    queries = spark.createDataFrame([(7, "b"), (7, "a")], "qid long, term string")
    top = retrieval.top_k(retrieval.bm25(pieces, "id", F.col("ts"), queries), 2).orderBy("rank").collect()
    assert [r.id for r in top] == [1, 2]
    idf = lambda df: math.log((3 - df + 0.5) / (df + 0.5) + 1)
    norm = 1 + 1.5 * (0.25 + 0.75 * 2 / (7 / 3))
    assert top[0].score == pytest.approx((idf(1) + idf(3)) * 2.5 / norm)


def test_paths_never_repeat_a_link(spark):
    data = [(1, "r", "a", "b", "increase", 0.9), (2, "r", "b", "a", "increase", 0.8), (3, "r", "b", "c", "decrease", 0.7)]
    links = spark.createDataFrame(data, "id long, relation string, source string, target string, direction string, confidence double")
    paths = graph.grow(links, links.where("id = 1"), 3)
    got = sorted([p["id"] for p in r.path] for r in paths.collect())
    assert got == [[1], [1, 2], [1, 3]]
    scored = paths.select("path", *graph.path_scores(F.col("path"), ["c"], "increase"))
    best = {tuple(p["id"] for p in r.path): round(r.score, 6) for r in scored.collect()}
    assert best[(1, 3)] == round(0.3 * 0.5 + 0.3 * 0.8 + 0.2 + 0.2, 6)
    kinds = {tuple(p["id"] for p in r.path): r.chain_type for r in graph.classify(scored).collect()}
    assert kinds[(1, 3)] == "primary" and kinds[(1,)] == "supporting"
    hops = {r.node: r.hop for r in graph.expand(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert hops == {"a": 0, "b": 1, "c": 2}


def test_paths_start_from_every_line_item(spark, tmp_path):
    items = [(1, 1, 1, 3, 30.0, 0.1, "A", "O")] + [(2, 1, 1, j % 4 * 2 + 1, 30.0, 0.1 - 0.001 * j, "N", "O") for j in range(25)]
    items = [(n, *r[1:]) for n, r in enumerate(items)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Counter()
    for r in registry.QUERIES["path_three_hops"](spark, str(tmp_path)).collect():
        got[r.length] += r.n
    assert got == {1: 1, 2: 20}  # no link is left out by number or quantity, and a tail takes its best 20
    assert registry.QUERIES["suppressed_paths"](spark, str(tmp_path)).count() == 5


def test_greedy_suppression(spark):
    df = spark.createDataFrame([("q", 1, ["a", "b", "c"], 0.9), ("q", 2, ["a", "b", "d"], 0.8), ("q", 3, ["x", "y"], 0.7), ("q", 4, ["a", "y", "z"], 0.6)], "g string, id long, m array<string>, s double")
    assert [r.id for r in graph.suppress(df, "g", "m", "s", 2).orderBy("rank").collect()] == [1, 3]
    # A candidate's own size counts, or the smaller one's, and the bound itself may be enough.
    df = spark.createDataFrame([("q", 1, ["a", "b"], 0.9), ("q", 2, ["a", "b", "c", "d"], 0.8), ("q", 3, ["a"], 0.7)], "g string, id long, m array<string>, s double")
    pick = lambda *a: [r.id for r in graph.suppress(df, "g", "m", "s", 5, *a).orderBy("rank").collect()]
    assert pick(0.5) == [1, 2] and pick(0.5, True) == [1] and pick(0.5, False, True) == [1]


def test_greedy_paths_go_to_the_best_unvisited_neighbour(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("b", "a", 0.95), ("a", "c", 0.1), ("d", "d", 1.0)], "source string, target string, confidence double")
    seeds = spark.createDataFrame([("a",), ("c",), ("d",), ("z",)], "node string")
    got = {r.node: r.path for r in graph.greedy_paths(links, seeds, 4).collect()}
    assert got == {"a": ["a", "b", "c"], "c": ["c", "b", "a"], "d": ["d"], "z": ["z"]}


def test_alignment_skips_deleted_rows_and_fails_on_others(spark):
    side = "g string, id long, name string, gone boolean"
    rows_ = spark.createDataFrame([("p", 1, "A.tif", False), ("p", 2, "x.tif", True), ("p", 3, "b.tif", True), ("p", 4, "c.tif", False), ("q", 1, "a", False), ("q", 2, "b", False), ("q", 3, "c", False), ("r", 1, "a", None)], side)
    told = spark.createDataFrame([("p", 11, "a.tif", None), ("p", 12, "B.tif", None), ("p", 13, "c.tif", None), ("q", 11, "a", None), ("q", 12, "c", None), ("s", 1, "a", None)], side).drop("gone")
    pairs = catalog.aligned(rows_, told, "g", "id", "name", "gone")
    got = {(r.g, r.id, r.other, r.status) for r in pairs.collect()}
    assert got == {("p", 1, 11, "paired"), ("p", 2, None, "skipped"), ("p", 3, 12, "paired"), ("p", 4, 13, "paired"), ("q", 1, 11, "paired"), ("q", 2, None, "failed"), ("q", 3, None, "open"), ("q", None, 12, "open"), ("r", 1, None, "failed"), ("s", None, 1, "failed")}
    assert catalog.require_aligned(pairs.where("g = 'p'")).count() == 3
    with pytest.raises(Exception, match="alignment failed at 2 b"):
        catalog.require_aligned(pairs.where("g = 'q'")).collect()


@pytest.mark.parametrize("train,test", [(3, 3), (5, 2), (1, 4), (0, 3), (4, 0), (2, 1)])
def test_alternating_split(spark, train, test):
    want, a, b, turn = {}, 0, 0, True
    for i in range(8):
        if i >= train + test:
            want[i] = "reserve"
        elif turn and a < train or b >= test:
            want[i], a = "train", a + 1
        else:
            want[i], b = "test", b + 1
        turn = not turn
    got = catalog.alternate(spark.range(8).withColumn("g", F.lit("x")), ["g"], [F.asc("id")], F.lit(train), F.lit(test)).collect()
    assert {r.id: r.part for r in got} == want


def test_suppression_walks_all_candidates(spark):
    near = [(g, n, ["a", "b", f"x{n}"], 1 - n / 1000) for g in ("p", None) for n in range(50)]
    df = spark.createDataFrame([*near, ("p", 50, ["c"], 0.2), ("p", 51, ["d"], 0.1), (None, 52, ["c"], 0.2), ("q", 53, [], 0.5), ("q", 54, None, 0.4)], "g string, id long, m array<string>, s double").repartition(3)
    got = graph.suppress(df, "g", "m", "s", 2)
    assert sorted(rows(got), key=repr) == sorted([("p", 1, 0, 1.0), ("p", 2, 50, 0.2), (None, 1, 0, 1.0), (None, 2, 52, 0.2), ("q", 1, 53, 0.5), ("q", 2, 54, 0.4)], key=repr)


def test_thresholds_and_kappa(spark):
    data = [(float(s), "straight" if s < 3 else "wavy" if s < 6 else "coiled") for s in range(10)]
    df = spark.createDataFrame(data, "s double, w string")
    best = evaluate.best_thresholds(df, "s", "w").first()
    assert (best.low, best.high, best.macro_f1) == (2.0, 5.0, 1.0)
    c = evaluate.confusion(df, F.col("w"), evaluate.banded(F.col("s"), F.lit(2.0), F.lit(5.0)))
    assert rows(evaluate.class_metrics(c, ["straight", "wavy", "coiled"])) == [(1.0, 1.0, 1.0, 1.0)]


def test_curvature_of_a_circle(spark):
    pts = [(1, 1, i, 10 * math.sin(i / 10), 10 * math.cos(i / 10)) for i in range(40)] + [(1, 2, i, 0.0, float(i)) for i in range(40)]
    df = spark.createDataFrame(pts, "image long, branch long, i int, y double, x double")
    k = {r.branch: r.k for r in images.point_curvature(df, "branch", "i").groupBy("branch").agg(F.avg("k").alias("k")).collect()}
    assert k[1] == pytest.approx(0.1) and k[2] == pytest.approx(0.0)
    assert images.curvature_bundle(df, "image", "branch", "i").first().p50_length == pytest.approx(0.1)
    same = images.junction_counts(spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (1, 0, 2, 1), (1, 1, 1, 1)], "g long, y int, x int, v int"), "g").first()
    assert (same.junctions, same.skeleton) == (2, 4) or same.skeleton == 4


def test_residual_baseline_meets_vectors_not_rows(spark, monkeypatch):
    met, packed = [], predict.blocks.packed
    monkeypatch.setattr(predict.blocks, "packed", lambda df, *a: met.append(df.count()) or packed(df, *a))
    n = np.arange(1200)
    fold, a, y = n % 3, n % 10 * 2.0, n * 7 % 31 + n % 10 * 1.0
    told = predict.residual_cv(spark.createDataFrame([*zip(n.tolist(), fold.tolist(), a.tolist(), y.tolist(), strict=True)], "id long, fold int, a double, y double"), ["a"], "y", [5.0], 3)
    got = {r.id: r for r in told.collect()}
    assert met == [10, 10] and len(got) == 1200 and told.columns == ["id", "fold", "a", "y", "baseline", "prediction"]
    weight = np.exp(-np.abs(a[:, None] - a[None, :]) / 5.0) * (n[:, None] != n[None, :])
    for f in range(3):
        outside = weight * (fold != f)[None, :]
        base = outside @ y / outside.sum(1)
        slope, intercept = np.polyfit(a[fold != f], (y - base)[fold != f], 1)
        for i in n[fold == f]:
            assert got[i].baseline == pytest.approx(base[i]) and got[i].prediction == pytest.approx(base[i] + slope * a[i] + intercept)


def test_junctions_without_a_join(spark):
    """Exploded rows look as small as what they came from, so a join of them would broadcast them all."""
    cross = [(1, y, x, int(y == 3 or x == 3)) for y in range(7) for x in range(7)]
    lone = [(2, 5, 5, 1), (3, 0, 0, 0), (None, 1, 1, 1), (None, 1, 2, 1)]
    twice = [(4, 0, 0, 1), (4, 0, 1, 1), (4, 0, 1, 1), (4, 0, 2, 1)]
    found = images.junction_counts(spark.createDataFrame(cross + lone + twice, "g long, y int, x int, v int"), "g")
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(1, 5, 4, 13), (2, 0, 0, 1), (None, 0, 0, 2), (4, 1, 0, 3)}


def test_neighbours_skip_missing_features(spark):
    pool = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 1.0, None, 2.0), (3, 5.0, 5.0, 3.0), (4, None, None, 4.0), (5, 0.0, 1.0, None)], "id long, a double, b double, y double")
    near = predict.neighbours(pool, pool.where("id = 1").withColumnRenamed("id", "qid"), ["a", "b"], "y", 5)
    assert [r.id for r in near.orderBy("rank").collect()] == [2, 3]
    assert 2 < predict.inverse_distance(near).first().baseline < 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("image_id,name\n007,温度\n".encode("gb18030"))
    assert rows(files.read_csv(spark, str(tmp_path / "a.csv"), "image_id string, name string")) == [("007", "温度")]
    (tmp_path / "b.csv").write_bytes("﻿x,y\n1,é\n".encode())
    assert rows(files.read_csv(spark, str(tmp_path / "b.csv"))) == [("1", "é")]
    (tmp_path / "held.json").write_text(json.dumps({"items": [{"id": "a", "ids": [1, 2]}]}))
    (tmp_path / "bare.json").write_text(json.dumps([{"id": "b", "ids": []}]))
    schema = "id string, ids array<bigint>"
    assert rows(files.read_items(spark, str(tmp_path / "held.json"), schema)) == [("a", [1, 2])]
    assert rows(files.read_items(spark, str(tmp_path / "bare.json"), schema)) == [("b", [])]
    side = tmp_path / "side"
    side.mkdir()
    (side / "s 1__features.json").write_text(json.dumps({"d": 1.5}))
    (side / "other.txt").write_text("温度")
    assert rows(files.read_sidecars(spark, str(side), "*__features.json", "d double"))[0][0] == 1.5
    found = files.list_files(spark, str(side), ("txt",))
    assert found.count() == 1 and files.latest_file(found, "other").first().path.endswith("other.txt")
    assert files.read_texts(spark, str(side / "other.txt")).first().lang == "zh"
    with zipfile.ZipFile(side / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p><w:r><w:t>you</w:t></w:r></w:p></w:body></w:document>')
    assert files.read_documents(spark, str(side)).first().text == "Hi\nyou"
    ledger = str(tmp_path / "ledger")
    files.append_ledger(spark.createDataFrame([("k",)], "signature string"), ledger)
    (tmp_path / "ledger" / "bad.json").write_text("{not json\n")
    assert rows(files.read_ledger(spark, ledger, "signature string")) == [("k",)]
    table = str(tmp_path / "table")
    for n in (1, 2):
        files.replace_table(spark.range(n), table)
        assert spark.read.parquet(table).count() == n
    files.write_csv(spark.range(2), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert files.report(spark.range(2)) == '{"id":0}\n{"id":1}'
    with pytest.raises(ValueError):
        files.report(spark.range(5), 3)


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    source, out, ledger = (str(tmp_path / n) for n in ("in", "out", "ledger"))
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, s string").write.parquet(source)
    schema = spark.read.parquet(source).schema
    for k in (0, 1):
        if k:
            spark.createDataFrame([(4, "b"), (5, "c")], "id long, s string").write.mode("append").parquet(source)
        ingest.ingest_once(ingest.arrivals(spark, source, schema), F.col("s"), out, ledger, str(tmp_path / "checkpoint")).awaitTermination()
        got = sorted(r.s for r in spark.read.parquet(out).collect())
        assert got == (["a", "b"], ["a", "b", "c"])[k]
    for k in range(2):  # a new checkpoint and smaller batches
        ingest.ingest_once(ingest.arrivals(spark, source, schema, per_trigger=1), F.col("s"), out, ledger, str(tmp_path / f"other{k}")).awaitTermination()
        assert sorted(r.s for r in spark.read.parquet(out).collect()) == sorted(r.signature for r in spark.read.parquet(ledger).collect()) == ["a", "b", "c"]
    ingest.process_new(ingest.arrivals(spark, source, schema), str(tmp_path / "copy"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 5
    assert ingest.remaining(spark.range(5), spark.range(3), "id").count() == 2


def test_rows_that_fail_or_hang_yield_errors(spark):
    import time

    import pyarrow as pa

    def work(row):
        if row["id"] == 1:
            raise KeyError("x")
        if row["id"] == 2:
            time.sleep(3)
        return {"id": row["id"] * 10}

    schema = pa.schema([("id", pa.int64()), ("error", pa.string())])
    begin = time.time()
    late = spark.range(2, 12).coalesce(1).mapInArrow(ingest.guarded(work, schema, 0.5), "id long, error string").collect()
    assert sorted((r.id, r.error) for r in late) == [(2, "TimeoutError"), *((k * 10, None) for k in range(3, 12))] and time.time() - begin < 3
    got = spark.range(3).coalesce(1).mapInArrow(ingest.guarded(work, schema, 0.5), "id long, error string").collect()
    assert sorted((r.id, r.error) for r in got) == [(0, None), (1, "KeyError"), (2, "TimeoutError")]


def test_waves_of_a_sine(spark):
    lines = [("flat", float(i), 0.0) for i in range(240)] + [("sine", float(i), 8 * math.sin(2 * math.pi * i / 40)) for i in range(240)]
    lines += [("short", float(i), 8 * math.sin(2 * math.pi * i / 8)) for i in range(10)]
    lines += [("turned", -8 * math.sin(2 * math.pi * i / 40), float(i)) for i in range(240)]  # the same, upright
    got = {r.b: r for r in images.wave_rows(spark.createDataFrame(lines, "b string, x double, y double").repartition(3), "b").collect()}
    assert got.keys() == {"sine", "turned"}
    r = got["sine"]
    assert 0.2 < r.ratio < 0.6 and abs(r.wavelength_px - 40) < 4 and abs(r.height_px - 16) < 4 and r.tortuosity > 1
    assert got["turned"].ratio == pytest.approx(r.ratio, rel=0.05)


def test_waves_without_a_join(spark):
    """Exploded points look as small as what they came from, so a join of them would broadcast them all."""
    point = F.explode(F.sequence(F.lit(0), F.lit(239))).alias("i")
    lines = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).alias("b"), point).select("b", F.col("i").cast("double").alias("x"), (8 * F.sin(2 * math.pi * F.col("i") / 40)).alias("y"))
    found = images.wave_rows(lines, "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = found.collect()
    assert sorted(r.b for r in got) == list(range(8)) and all(r[1:] == got[0][1:] for r in got)
    assert sorted(got) == sorted(images.wave_rows(lines.repartition(7), "b").collect())


def test_turns_keep_the_more_extreme_rival(spark):
    heights = [0, 3, 0, 4, 0, 0, 0, 0, 0, 0, 0, -5, 0, -2, 0, 0, 0, 0, 0, 0, 0, 0, 6, 0]
    df = spark.createDataFrame([("b", i, float(i), float(h)) for i, h in enumerate(heights)], "b string, c int, s double, level double")
    r = images.turns(df, "b", 4.0).first()
    assert [(t.s, t.kind) for t in r.turns] == [(3.0, 1), (13.0, -1), (22.0, 1)] and r.span == pytest.approx(23.0)


def test_entry_stands_without_the_corpus_operators_libraries():
    """A library that only they need may be missing."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, corpus = said.stdout.split()[-2:]
    assert int(count) > 130 and corpus == "False"


def test_workbooks_and_slides(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>'
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="First"/></sheets></workbook>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for name, text in (("xl/workbook.xml", book), ("xl/sharedStrings.xml", shared), ("xl/worksheets/sheet1.xml", sheet)):
            z.writestr(name, text)
    got = sorted((r.sheet, r.row, r.cells) for r in files.read_workbooks(spark, str(tmp_path)).collect())
    assert got == [("First", 1, ["one", "", "2.5"]), ("First", 3, ["", "in"])]
    slide = '<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:t>Hello</a:t><a:t> there</a:t></a:p><a:p><a:t>you</a:t></a:p></p>'
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        for n in (2, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", slide)
    assert sorted((r.slide, r.text) for r in files.read_slides(spark, str(tmp_path)).collect()) == [(1, "Hello there\nyou"), (2, "Hello there\nyou")]
