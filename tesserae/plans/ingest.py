"""Queries of ingest: candidates in order, signatures known already, what remains, streams."""

from __future__ import annotations

import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import parsing, text
from tesserae.plans.registry import Tables, query
from tesserae.sources import files
from tesserae.streaming import ingest


@query("K05", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END DESC, o_orderkey % 50 DESC, lower(o_orderpriority), o_orderkey LIMIT 100")
def sorted_candidates(t: Tables) -> DataFrame:
    rank = F.coalesce(F.element_at(F.create_map(F.lit("1"), F.lit(3), F.lit("2"), F.lit(2), F.lit("3"), F.lit(1)), F.substring("o_orderpriority", 1, 1)), F.lit(0))
    return t.orders.select("o_orderkey", "o_orderpriority").orderBy(rank.desc(), (F.col("o_orderkey") % 50).desc(), F.lower("o_orderpriority"), "o_orderkey").limit(100)


@query("T05 J20", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def remaining_pages(t: Tables) -> DataFrame:
    return ingest.remaining(t.pages.select("page_id"), t.pages.where("page_id % 3 = 0"), "page_id")


HOSTS = "count(DISTINCT lower(regexp_extract(url, '//([^/?#]*)', 1)))"


@query("T02 S13 F14", f"SELECT 'ledger' AS place, {HOSTS} AS n FROM pages UNION ALL SELECT 'rows', {HOSTS} FROM pages")
def ledger_exactly_once(t: Tables) -> DataFrame:
    """Pages streamed in three times, the second time from a new checkpoint and in batches of another
    size, the third time on with the first checkpoint: ledger and table have one row for each host."""
    root = _scratch(t)
    source, out, ledger = f"{root}/in", f"{root}/out", f"{root}/ledger"
    t.pages.select("page_id", "url").repartition(5).write.parquet(source)
    host = F.lower(F.regexp_extract("url", "//([^/?#]*)", 1))
    schema = t.spark.read.parquet(source).schema
    for checkpoint, files_at_a_time in (("a", 2), ("b", 5), ("a", 1)):
        ingest.ingest_once(ingest.arrivals(t.spark, source, schema, per_trigger=files_at_a_time), host, out, ledger, f"{root}/checkpoint-{checkpoint}").awaitTermination()
    count = lambda place, folder: t.spark.read.parquet(folder).agg(F.lit(place).alias("place"), F.count(F.lit(1)).alias("n"))
    return count("ledger", ledger).unionByName(count("rows", out))


@query("T03", "SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY event_type")
def only_unprocessed(t: Tables) -> DataFrame:
    """Events that arrive in two parts: the second run takes what came since the first, nothing twice."""
    root = _scratch(t)
    rows = t.events.select("event_id", "event_type")
    for part in range(2):
        rows.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        ingest.process_new(ingest.arrivals(t.spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    done = t.spark.read.parquet(f"{root}/out")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("T04", "SELECT s_suppkey, CASE WHEN s_suppkey % 25 = 7 THEN 'TimeoutError' WHEN s_suppkey % 25 = 9 THEN 'ValueError' END AS error, CASE WHEN s_suppkey % 25 NOT IN (7, 9) THEN length(s_name) END AS n FROM supplier WHERE s_suppkey <= 50")
def guarded_rows(t: Tables) -> DataFrame:
    """Rows of which some hang and some fail: each has its error, and the others their results. Fifty
    rows are asked for, since every hanging row costs its time limit."""
    return t.supplier.where("s_suppkey <= 50").select("s_suppkey", "s_name").mapInArrow(ingest.guarded(_measured, _MEASURED, 0.5), "s_suppkey long, n long, error string")


_MEASURED = pa.schema([("s_suppkey", pa.int64()), ("n", pa.int64()), ("error", pa.string())])


def _measured(row: dict) -> dict:
    if row["s_suppkey"] % 25 == 7:
        time.sleep(60)
    if row["s_suppkey"] % 25 == 9:
        raise ValueError("a row's own failure")
    return {"s_suppkey": row["s_suppkey"], "n": len(row["s_name"])}


def _scratch(t: Tables) -> str:
    """A new folder that all executors share: below the session's checkpoint folder, or a local one
    where driver and executors are one process."""
    named = t.spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/tesserae/stream-{uuid.uuid4().hex}"
    if not (t.spark.sparkContext.master == "local" or t.spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tesserae-stream-") + "/s"


@query("S18", """
SELECT p_partkey, k - 1 AS place, CASE k WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE 'Table' END AS title FROM part, (SELECT unnest([1, 2]) AS k)""")
def markdown_sections(t: Tables) -> DataFrame:
    """Sections of Markdown made from parts, with their titles."""
    md = F.concat(F.lit("# "), "p_brand", F.lit("\n"), "p_name", F.lit("\n\n## "), "p_type", F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\n"))
    pages = t.part.select("p_partkey", F.posexplode(files.markdown_pages(md)).alias("place", "page"))
    return pages.select("p_partkey", F.col("place").cast("long").alias("place"), F.regexp_replace(F.split("page", "\n")[0], "^#+ *", "").alias("title"))


@query("F15 F22", "SELECT doc_id, 'na_' || lang || '_' || substr(sha1(source || doc_id), 1, 10) || '.txt' AS name FROM documents")
def stable_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("na_"), text.slug(F.col("lang")), F.lit("_"), text.fingerprint(F.concat("source", "doc_id")), F.lit(".txt")).alias("name"))


@query("S04 S14 S13", "SELECT 'csv' AS source, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier UNION ALL SELECT 'ledger', CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def file_round_trips(t: Tables) -> DataFrame:
    """Rows written as CSV and as lines of a ledger, and read back."""
    root = _scratch(t)
    rows = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    files.write_csv(rows, f"{root}/csv")
    files.append_ledger(rows.where("s_suppkey % 2 = 0"), f"{root}/ledger")
    files.append_ledger(rows.where("s_suppkey % 2 = 1"), f"{root}/ledger")
    files.put(t.spark, f"{root}/ledger/broken.json", b"{not a line\n")
    csv, ledger = files.read_csv(t.spark, f"{root}/csv", "id string, name string"), files.read_ledger(t.spark, f"{root}/ledger", "id string, name string")
    return csv.select(F.lit("csv").alias("source"), "id", "name").unionByName(ledger.select(F.lit("ledger").alias("source"), "id", "name"))


@query("S03", "SELECT e.encoding, CAST(r_regionkey AS VARCHAR) AS id, r_name || '温度' AS name FROM region, (SELECT unnest(['utf-8-sig', 'gb18030']) AS encoding) e")
def csv_encodings(t: Tables) -> DataFrame:
    """The same lines in a file with a byte order mark and in one of an older encoding."""
    root = _scratch(t)
    lines = "id,name\n" + "".join(f"{r.r_regionkey},{r.r_name}温度\n" for r in t.region.orderBy("r_regionkey").collect())  # five rows
    out = []
    for encoding in ("utf-8-sig", "gb18030"):
        files.put(t.spark, f"{root}/{encoding}/a.csv", lines.encode(encoding))
        out.append(files.read_csv(t.spark, f"{root}/{encoding}", "id string, name string").select(F.lit(encoding).alias("encoding"), "id", "name"))
    return out[0].unionByName(out[1])


@query("S05", "SELECT k AS form, n_nationkey AS id, n_name AS name FROM nation, (SELECT unnest(['bare', 'held']) AS k)")
def json_items(t: Tables) -> DataFrame:
    """Documents that are a list, or hold one under `items`."""
    root = _scratch(t)
    rows = F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))  # 25 rows
    t.nation.agg(F.to_json(rows).alias("value")).write.text(f"{root}/bare")
    t.nation.agg(F.to_json(F.struct(rows.alias("items"))).alias("value")).write.text(f"{root}/held")
    read = [files.read_items(t.spark, f"{root}/{form}", "id int, name string").select(F.lit(form).alias("form"), "id", "name") for form in ("bare", "held")]
    return read[0].unionByName(read[1])


def _nation_files(t: Tables, root: str, name: str, text: str) -> None:
    """A file for each of the 25 nations; `name` and `text` are formats of its row."""
    for r in t.nation.orderBy("n_nationkey").collect():
        files.put(t.spark, f"{root}/{name.format(r=r)}", text.format(r=r).encode(), 1_700_000_000 + (r.n_nationkey * 7) % 25)


@query("S06", "SELECT n_nationkey || '_50000' AS key, n_name AS name, n_regionkey AS region FROM nation")
def side_cars(t: Tables) -> DataFrame:
    root = _scratch(t)
    _nation_files(t, root, "{r.n_nationkey}_50000__features.json", '{{"name": "{r.n_name}",\n "region": {r.n_regionkey}}}')
    _nation_files(t, root, "{r.n_nationkey}_10000__features.json", "{{}}")
    return files.read_sidecars(t.spark, root, "*50000*__features.json", "name string, region int").select("key", "name", "region")


@query("S07", "SELECT n_regionkey || '/' || n_nationkey || '.' || x AS name, CAST(length(n_name) AS BIGINT) AS length FROM nation, (SELECT unnest(['txt', 'md']) AS x)")
def file_listing(t: Tables) -> DataFrame:
    """Files below a folder by extension."""
    root = _scratch(t)
    for extension in ("txt", "md", "csv"):
        _nation_files(t, root, "{r.n_regionkey}/{r.n_nationkey}." + extension, "{r.n_name}")
    return files.list_files(t.spark, root, ("txt", "md")).select(F.regexp_extract("path", r"(\d+/\d+\.\w+)$", 1).alias("name"), "length")


@query("S08", "SELECT CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_regionkey = 2 THEN '温度 ' ELSE '' END || n_name AS text, CASE WHEN n_regionkey = 2 THEN 'zh' ELSE 'en' END AS lang FROM nation")
def text_files(t: Tables) -> DataFrame:
    """Whole files and their language by the letters they hold."""
    root = _scratch(t)
    for r in t.nation.collect():
        files.put(t.spark, f"{root}/{r.n_nationkey}.txt", (("温度 " if r.n_regionkey == 2 else "") + r.n_name).encode())
    return files.read_texts(t.spark, root).select(F.regexp_extract("path", r"(\d+)\.txt$", 1).alias("name"), "text", "lang")


@query("S12", "SELECT 'report_' || arg_max(n_nationkey, (n_nationkey * 7) % 25) || '.json' AS name FROM nation")
def newest_report(t: Tables) -> DataFrame:
    root = _scratch(t)
    _nation_files(t, root, "report_{r.n_nationkey}.json", "{{}}")
    files.put(t.spark, f"{root}/other.json", b"{}", 1_800_000_000)
    newest = files.latest_file(files.list_files(t.spark, root, ("json",)), "report_")
    return newest.select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("S16", "SELECT '{\"r\":' || n_regionkey || ',\"n\":' || count(*) || '}' AS line FROM nation GROUP BY n_regionkey")
def report_lines(t: Tables) -> DataFrame:
    """A small aggregate written as a report and read back."""
    root = _scratch(t)
    said = files.report(t.nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.count(F.lit(1)).alias("n")))
    files.put(t.spark, f"{root}/report.jsonl", said.encode())
    return t.spark.read.text(root).select(F.col("value").alias("line"))


@query("S20 S19", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 7")
def swapped_table(t: Tables) -> DataFrame:
    """A table copied, changed and put in the old one's place: one row renamed, one deleted."""
    path = f"{_scratch(t)}/nation"
    files.replace_table(t.nation.select("n_nationkey", "n_name"), path)
    old = t.spark.read.parquet(path)
    files.replace_table(old.where("n_nationkey <> 7").withColumn("n_name", F.when(F.col("n_nationkey") == 3, "renamed").otherwise(F.col("n_name"))), path)
    return t.spark.read.parquet(path)


@query("S11", """
SELECT 'C' || (n_nationkey % 10 + 1) || '-B' || (n_nationkey % 5) AS sample_id, CAST(750 + n_nationkey AS DOUBLE) AS growth_temp, CAST(100 + n_nationkey AS DOUBLE) AS ar_flow, 0.5 AS catalyst_weight, DATE '2024-01-05' AS day, count(*) AS n
FROM nation, (SELECT unnest([1, 2]) AS run) GROUP BY ALL""")
def folder_ingest(t: Tables) -> DataFrame:
    """Files of a folder tree listed, their names parsed, and appended to a table, twice."""
    root = _scratch(t)
    _nation_files(t, root, "in/240105 T{r.n_nationkey}50 x/readme.txt", "no image")
    for r in t.nation.collect():
        files.put(t.spark, f"{root}/in/240105 T{750 + r.n_nationkey} 3H L{100 + r.n_nationkey} 0.5g/C{r.n_nationkey % 10 + 1}B{r.n_nationkey % 5}.tiff", b"II*")
    for _run in range(2):
        found = files.list_files(t.spark, f"{root}/in", ("tiff",)).select(F.regexp_replace("path", "%20", " ").alias("path"))
        parts = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("folder"))
        parsed = parts.select(parsing.short_name(F.col("file"), F.col("folder")).alias("s"), parsing.experiment_date(F.col("folder")).alias("day"))
        parsed.select("s.sample_id", "s.growth_temp", "s.ar_flow", "s.catalyst_weight", "day").write.mode("append").parquet(f"{root}/images")
    images = t.spark.read.parquet(f"{root}/images")
    return images.groupBy("sample_id", "growth_temp", "ar_flow", "catalyst_weight", "day").agg(F.count(F.lit(1)).alias("n"))
