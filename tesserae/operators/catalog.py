"""Listing, paging, latest versions, keyed upsert and dedup of measurement rows."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, view: str = "active", flag: str = "is_deleted") -> Column:
    """Active, deleted or all rows; without a flag column nothing is deleted."""
    if view == "all":
        return F.lit(True)
    if flag not in df.columns:
        return F.lit(view == "active")
    gone = F.coalesce(F.col(flag), F.lit(0)) == 1
    return gone if view == "deleted" else ~gone


def conjunction(*terms: Column | None) -> Column:
    """All given terms; none given is true."""
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def contains_any(needle: str, *columns: str) -> Column:
    """A text in one of the columns, whatever its case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False)) for c in columns])


def order(allowed: dict[str, str], by: str | None, way: str = "desc", default: str = "id") -> list[Column]:
    """A listed column in the asked direction, then the id; unknown names fall back to the id."""
    column = F.col(allowed.get(by or "", default))
    first = column.asc() if way.lower() == "asc" else column.desc()
    return [first] if allowed.get(by or "", default) == default else [first, F.col(default).asc()]


def page(df: DataFrame, sort: list[Column], limit: int, offset: int) -> DataFrame:
    """K02"""
    return df.orderBy(*sort).offset(offset).limit(limit)


def latest(df: DataFrame, key: str, version: str, *values: str) -> DataFrame:
    """The values of each key's largest version, in one aggregation."""
    return df.groupBy(key).agg(F.max(version).alias(version), *[F.max_by(v, version).alias(v) for v in values])


def best_per(df: DataFrame, keys: list[str], sort: list[Column], n: int = 1) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))).where(F.col("_n") <= n).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where given, old ones otherwise, and rows of either side alone."""
    n = new.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(n, old[key] == n["_k"], "full_outer")
    return joined.select(F.coalesce(F.col(key), F.col("_k")).alias(key), *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in columns])


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is there already are ignored; of new rows of one key one goes in."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(old.columns))


def resolve(df: DataFrame, key: Column, rank: Column) -> DataFrame:
    """Rows of one entity merged field by field: the best rank, the longest title, the first
    year given, all tags, all notes once."""
    g = df.withColumn("_key", key).withColumn("_rank", rank).groupBy("_key")
    longest = F.struct(F.length("title"), (-F.col("id")).alias("i"))
    return g.agg(
        F.max("_rank").alias("rank"), F.max_by("title", longest).alias("title"), F.min_by("year", F.when(F.col("year").isNotNull(), F.col("id"))).alias("year"),
        F.array_join(F.sort_array(F.collect_set("tag")), ";").alias("tags"), F.array_join(F.sort_array(F.collect_set("note")), " | ").alias("notes"), F.count(F.lit(1)).alias("n"),
    )


def aligned(rows: DataFrame, summary: DataFrame, group: str, order_by: str, name: str, deleted: str) -> DataFrame:
    """Two ordered streams of a group paired one after the other. Rows whose name is the next
    one of the summary's pair with it; deleted rows of another name are skipped; anything else is a
    failure, and what comes after it stays open.

    One row a row or unmatched summary row: group, `id` and `other` (`order_by` of either side),
    name and status: paired, skipped, failed (the first mismatch of a group, or a row left over) or
    open. A group's names, in order, are held in its task."""
    a = rows.select(F.col(group).alias("g"), F.col(order_by).cast("long").alias("id"), F.lower(name).alias("name"), F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)).alias("gone"))
    b = summary.select(F.col(group).alias("g"), F.col(order_by).cast("long").alias("id"), F.lower(name).alias("name"))
    kind = a.schema["g"].dataType.simpleString()
    out = a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(_pair_up, f"g {kind}, id long, other long, name string, status string")
    return out.withColumnRenamed("g", group)


def _pair_up(rows: pa.Table, summary: pa.Table) -> pa.Table:
    mine, theirs = ([x for x in t.sort_by("id").to_pylist()] for t in (rows, summary))
    out, at, broken = [], 0, False
    for r in mine:
        here = at < len(theirs)
        if broken:
            out.append((r["g"], r["id"], None, r["name"], "open"))
        elif here and r["name"] == theirs[at]["name"]:
            out.append((r["g"], r["id"], theirs[at]["id"], r["name"], "paired"))
            at += 1
        else:
            broken = not r["gone"]
            out.append((r["g"], r["id"], None, r["name"], "failed" if broken else "skipped"))
    for x in theirs[at:]:
        out.append((x["g"], None, x["id"], x["name"], "open" if broken else "failed"))
    kind = (rows if rows.num_rows else summary).schema.field("g").type
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("g", "id", "other", "name", "status"), columns, (kind, pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})


def require_aligned(pairs: DataFrame) -> DataFrame:
    """The pairs alone; an error where any row has failed to pair."""
    bad = F.raise_error(F.concat(F.lit("alignment failed at "), F.coalesce(F.col("id").cast("string"), F.lit("the end")), F.lit(" "), F.coalesce("name", F.lit(""))))
    return pairs.where(F.when(F.col("status") == "failed", bad.cast("boolean")).otherwise(F.col("status") == "paired"))


def alternate(df: DataFrame, group: list[str], order_by: list[Column], train: Column, test: Column) -> DataFrame:
    """Rows of a group in order go to train and test by turns until the smaller part is full,
    then to the larger one; rows beyond both are a reserve. `train` and `test` are the group's numbers."""
    i = F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)) - 1
    both = df.withColumn("_i", i).withColumn("_a", train).withColumn("_b", test)
    part = (
        F.when(F.col("_i") >= F.col("_a") + F.col("_b"), "reserve")
        .when(F.col("_i") < 2 * F.least("_a", "_b"), F.when(F.col("_i") % 2 == 0, "train").otherwise("test"))
        .otherwise(F.when(F.col("_a") >= F.col("_b"), "train").otherwise("test"))
    )
    return both.withColumn("part", part).drop("_i", "_a", "_b")


def valid_ids(ids: Column) -> Column:
    """Distinct whole numbers in the order given; null where none is left."""
    kept = F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))
    return F.when(F.size(kept) > 0, kept)


def split_by_group(groups: DataFrame, key: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Whole groups to train, val or test by a hash of their key, so the same key always goes
    to the same part and no order over all groups is needed."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10000 / 10000.0
    return groups.withColumn("part", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))
