"""Sources and sinks: tables, CSV in several encodings, JSON documents and side-cars, folders, ledgers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encodings: tuple[str, ...] = ("utf-8", "gb18030")) -> DataFrame:
    """The first encoding in which the file's text has no replacement character. The
    probe reads the file distributed, as bytes; the schema is given, never inferred."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    for encoding in encodings:
        broken = raw.mapInArrow(_undecodable(encoding), "bad boolean").where("bad").limit(1)
        if broken.isEmpty():
            if encoding not in _BUILT_IN:
                return _csv_rows(spark, raw, encoding, schema)
            reader = spark.read.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True)
            out = (reader.schema(schema) if schema else reader).csv(path)
            return out.withColumnsRenamed({c: c.lstrip("﻿") for c in out.columns if c.startswith("﻿")})
    raise UnicodeError(f"{path} is in none of {', '.join(encodings)}")


_BUILT_IN = {"utf-8", "utf-16", "utf-16le", "utf-16be", "utf-32", "iso-8859-1", "us-ascii"}


def _csv_rows(spark: SparkSession, raw: DataFrame, encoding: str, schema: str | None) -> DataFrame:
    """Files in an encoding that Spark's own reader doesn't know, a file in a task; columns by
    place, named by the schema or the first file's header."""
    import csv

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column("content").to_pylist():
                lines = list(csv.reader(io.StringIO(data.decode(encoding).lstrip("\ufeff"))))
                yield pa.RecordBatch.from_arrays([pa.array([k == 0 for k in range(len(lines))], pa.bool_()), pa.array(lines, pa.list_(pa.string()))], names=["head", "cells"])

    parsed = raw.mapInArrow(parse, "head boolean, cells array<string>")
    if schema:
        fields = [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema]
    else:
        head = parsed.where("head").limit(1).collect()
        fields = [(n, "string") for n in head[0]["cells"]] if head else []
    return parsed.where("NOT head").select(*[F.nullif(F.get("cells", k), F.lit("")).try_cast(kind).alias(n) for k, (n, kind) in enumerate(fields)])


def _undecodable(encoding: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for data in b.column("content").to_pylist():
                try:
                    data.decode(encoding)
                    out.append(False)
                except UnicodeDecodeError:
                    out.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.bool_())], names=["bad"])

    return run


def write_csv(df: DataFrame, path: str) -> None:
    """S14"""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with a list under `items`, or a bare list; one row an item."""
    whole = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{schema}>>")
    held = F.from_json("value", f"items array<struct<{schema}>>")["items"]
    is_list = F.ltrim(F.col("value")).startswith("[")
    return whole.select(F.explode(F.when(is_list, bare).otherwise(held)).alias("item")).select("item.*")


def read_sidecars(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """JSON files of a name pattern, with the file's stem as key."""
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"(__features)?\.json$", "")
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(folder).withColumn("key", stem)


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Paths, sizes and times of files below a folder, by extension; contents aren't read."""
    names = "*.{" + ",".join(extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder).select("path", "length", "modificationTime")


def latest_file(files: DataFrame, prefix: str) -> DataFrame:
    """The newest path whose folder or name has a prefix."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.startswith(prefix)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files with a language flag by CJK letters."""
    t = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.withColumn("lang", F.when(F.col("text").rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of word-processor files, which are zipped XML."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for b in it:
            texts = []
            for data in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    tree = ElementTree.fromstring(z.read("word/document.xml"))
                texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in tree.iter(f"{space}p")))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook; shared and inline texts resolved, gaps empty."""
    names = set(book.namelist())
    shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in x.iter(f"{_SHEET}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    titles = [x.get("name") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
    for k, title in enumerate(titles, 1):
        if f"xl/worksheets/sheet{k}.xml" not in names:
            continue
        for r, row in enumerate(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_SHEET}row"), 1):
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                letters = "".join(x for x in c.get("r") or "" if x.isalpha())
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                cells += [""] * (column - 1 - len(cells))
                value = c.find(f"{_SHEET}v")
                said = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if value is None else value.text or ""
                cells.append(shared[int(said)] if c.get("t") == "s" else said)
            yield title, int(row.get("r") or r), cells


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all sheets of workbooks, which are zipped XML: path, sheet, row, cells."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
        for b in it:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield pa.RecordBatch.from_pylist([{"path": path, "sheet": s, "row": r, "cells": c} for s, r, c in _sheet_rows(z)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")


def read_slides(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the slides of presentations, which are zipped XML: path, slide, text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
        schema = pa.schema([("path", pa.string()), ("slide", pa.int32()), ("text", pa.string())])
        for b in it:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                out = []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        if name.startswith("ppt/slides/slide") and name.endswith(".xml"):
                            tree = ElementTree.fromstring(z.read(name))
                            said = "\n".join("".join(t.text or "" for t in p.iter(f"{draw}t")) for p in tree.iter(f"{draw}p"))
                            out.append({"path": path, "slide": int(name[16:-4]), "text": said})
                yield pa.RecordBatch.from_pylist(sorted(out, key=lambda x: x["slide"]), schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pptx").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, slide int, text string")


def put(spark: SparkSession, path: str, data: bytes, seconds: int | None = None) -> None:
    """A small file, by the file system of its path; its time is set where given."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(data)
    out.close()
    if seconds is not None:
        fs.setTimes(target, seconds * 1000, -1)


def markdown_pages(text: Column) -> Column:
    """Sections of a Markdown text, a heading with each."""
    return F.filter(F.split(text, r"\n(?=#{1,6} )"), lambda s: F.trim(s) != "")


def markdown_tables(text: Column) -> Column:
    """Runs of lines that begin with a bar, as HTML rows."""
    tables = F.regexp_extract_all(text, F.lit(r"(?m)((?:^\|.*\|[ \t]*\n?)+)"), F.lit(1))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.concat(F.lit("<td>"), F.trim(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    keep = lambda t: F.filter(F.split(t, "\n"), lambda r: (F.trim(r) != "") & ~r.rlike(r"^\|[\s:|-]+\|\s*$"))
    return F.transform(tables, lambda t: F.concat(F.lit("<table>"), F.array_join(F.transform(keep(t), row), ""), F.lit("</table>")))


def append_ledger(df: DataFrame, path: str) -> None:
    """S13"""
    df.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A rewritten table goes to a new place first, then takes the old one's name."""
    spark = df.sparkSession
    sc = spark.sparkContext
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    P = sc._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    fs.rename(P(fresh), P(path))
    fs.delete(P(old), True)


def report(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as JSON lines, for reports; refuses more than `most` rows."""
    rows = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return "\n".join(rows)
