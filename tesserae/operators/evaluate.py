"""Evaluation of classes and thresholds from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, wanted: Column, told: Column) -> DataFrame:
    """(wanted, told, n, share of the wanted class)."""
    n = rows.groupBy(wanted.alias("wanted"), told.alias("told")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("wanted")))


def class_metrics(counts: DataFrame, classes: list[str]) -> DataFrame:
    """Accuracy, macro-F1, balanced accuracy and quadratic kappa from confusion counts, in
    one row: as many sums as there are classes, squared."""
    k = len(classes)
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col("wanted") == a) & (F.col("told") == b), F.col("n"))), F.lit(0)).cast("double")
    m = counts.agg(*[cell(a, b).alias(f"c{i}_{j}") for i, a in enumerate(classes) for j, b in enumerate(classes)])
    c = [[F.col(f"c{i}_{j}") for j in range(k)] for i in range(k)]
    row = [sum(r[1:], r[0]) for r in c]
    col = [sum([c[i][j] for i in range(1, k)], c[0][j]) for j in range(k)]
    total = sum(row[1:], row[0])
    hit = sum([c[i][i] for i in range(1, k)], c[0][0])
    f1 = [F.when(row[i] + col[i] > 0, 2 * c[i][i] / (row[i] + col[i])).otherwise(0.0) for i in range(k)]
    recall = [F.when(row[i] > 0, c[i][i] / row[i]) for i in range(k)]
    some = sum([F.when(row[i] > 0, 1).otherwise(0) for i in range(1, k)], F.when(row[0] > 0, 1).otherwise(0))
    weighted = [(i - j) ** 2 for i in range(k) for j in range(k)]
    seen = sum([w * c[n // k][n % k] for n, w in enumerate(weighted)][1:], F.lit(0.0))
    chance = sum([w * row[n // k] * col[n % k] / total for n, w in enumerate(weighted)][1:], F.lit(0.0))
    rnd = lambda x: F.round(x, 8)
    return m.select(rnd(hit / total).alias("accuracy"), rnd(sum(f1[1:], f1[0]) / k).alias("macro_f1"), rnd(sum([F.coalesce(r, F.lit(0.0)) for r in recall][1:], F.coalesce(recall[0], F.lit(0.0))) / some).alias("balanced_accuracy"), rnd(F.when(chance > 0, 1 - seen / chance)).alias("weighted_kappa"))


def banded(score: Column, low: Column, high: Column) -> Column:
    """E08"""
    return F.when(score <= low, "straight").when(score <= high, "wavy").otherwise("coiled")


def best_thresholds(rows: DataFrame, score: str, wanted: str) -> DataFrame:
    """The pair of thresholds of best macro-F1, then balanced accuracy, then accuracy, then the
    lowest. Rows are first counted by distinct score and class, and running counts give any
    pair's confusion counts, so pairs join on counts of distinct scores and never on rows."""
    n = rows.groupBy(F.col(score).alias("s")).agg(*[F.sum(F.when(F.col(wanted) == c, 1).otherwise(0)).alias(c) for c in ("straight", "wavy", "coiled")])
    one = Window.partitionBy(F.lit(1)).orderBy("s")
    run = n.select("s", *[F.sum(c).over(one).alias(c) for c in ("straight", "wavy", "coiled")])
    total = n.agg(*[F.sum(c).alias(f"t_{c}") for c in ("straight", "wavy", "coiled")])
    a = run.select(F.col("s").alias("low"), *[F.col(c).alias(f"a_{c}") for c in ("straight", "wavy", "coiled")])
    b = run.select(F.col("s").alias("high"), *[F.col(c).alias(f"b_{c}") for c in ("straight", "wavy", "coiled")])
    p = a.join(b, F.col("low") < F.col("high")).crossJoin(F.broadcast(total))  # one row of totals
    hit = {"straight": F.col("a_straight"), "wavy": F.col("b_wavy") - F.col("a_wavy"), "coiled": F.col("t_coiled") - F.col("b_coiled")}
    add = lambda k: sum([F.col(f"{k}_{c}") for c in ("wavy", "coiled")], F.col(f"{k}_straight"))
    told = {"straight": add("a"), "wavy": add("b") - add("a"), "coiled": add("t") - add("b")}
    f1 = [F.when(F.col(f"t_{c}") + told[c] > 0, 2 * hit[c] / (F.col(f"t_{c}") + told[c])).otherwise(0.0) for c in hit]
    recall = [F.when(F.col(f"t_{c}") > 0, hit[c] / F.col(f"t_{c}")).otherwise(0.0) for c in hit]
    rank = F.struct(F.round((f1[0] + f1[1] + f1[2]) / 3, 9).alias("macro_f1"), F.round((recall[0] + recall[1] + recall[2]) / 3, 9).alias("balanced_accuracy"), F.round((hit["straight"] + hit["wavy"] + hit["coiled"]) / add("t"), 9).alias("accuracy"), (-F.col("low")).alias("l"), (-F.col("high")).alias("h"))
    best = p.agg(F.max(rank).alias("r"))
    return best.select((-F.col("r.l")).alias("low"), (-F.col("r.h")).alias("high"), "r.macro_f1", "r.balanced_accuracy", "r.accuracy")


def against_baseline(rows: DataFrame, name: str, value: str, baseline: str) -> DataFrame:
    """Difference and percent change of each variant against one named row."""
    base = rows.where(F.col(name) == baseline).agg(F.first(value).alias("_b"))
    return rows.crossJoin(F.broadcast(base)).select(*rows.columns, (F.col(value) - F.col("_b")).alias("delta"), F.when(F.col("_b") != 0, (F.col(value) - F.col("_b")) / F.col("_b") * 100).alias("percent")).drop("_b")
