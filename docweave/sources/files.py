"""Files as DataFrames: text, tables, office documents; checks of what an upload claims to be.

A file is one row of Spark's ``binaryFile`` source; the helpers below look at one file's bytes at a time.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits of office containers.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 5000, 512 << 20, 200
_MAIN_PART = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_type (the name's extension in lower case), length, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("file_type"), "length", "content")


def detected_type(content: Column) -> Column:
    """What the first bytes say: pdf, zip, text, or unknown where a text would hold no zero byte."""
    head = F.hex(F.substring(content, 1, 4))
    text = ~F.hex(F.substring(content, 1, 4096)).rlike("^(..)*00")
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").when(text, "text").otherwise("unknown")


def type_matches(file_type: Column, content: Column) -> Column:
    want = F.when(file_type == "pdf", "pdf").when(file_type.isin("docx", "xlsx"), "zip").otherwise("text")
    return detected_type(content) == want


def decode_text(files: DataFrame) -> DataFrame:
    """Files with ``text``; bytes that are not UTF-8 give null and ``valid`` false. Line ends are normalised, a byte-order
    mark is dropped."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), "^﻿", ""), "\r\n?", "\n")
    return files.withColumn("valid", ok).withColumn("text", F.when(ok, text))


@F.pandas_udf(StringType())
def zip_problem(content: pd.Series, file_type: pd.Series) -> pd.Series:
    """Why an office container is refused, else null."""

    def look(raw: bytes | None, kind: str) -> str | None:
        try:
            members = zipfile.ZipFile(io.BytesIO(raw or b"")).infolist()
        except zipfile.BadZipFile:
            return "not a zip"
        if len(members) > MOST_MEMBERS:
            return "too many members"
        if any(m.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", m.filename) for m in members):
            return "unsafe path"
        size, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
        if size > MOST_BYTES:
            return "too large"
        if size > MOST_RATIO * max(packed, 1):
            return "compressed too well"
        if kind in _MAIN_PART and _MAIN_PART[kind] not in {m.filename for m in members}:
            return "main part missing"
        return None

    return pd.Series([look(c, k) for c, k in zip(content, file_type, strict=True)], dtype=object)


CELLS = "path string, sheet string, row_no int, cells array<string>"


def sniff(sample: str) -> str:
    """The delimiter of a table: of comma, semicolon, tab and pipe the one most lines have equally often; else a comma."""
    rows = [r for r in sample.splitlines()[:50] if r.strip()]
    best, found = (0, 0), ","
    for d in ",;\t|":
        counts = [len(next(csv.reader([r], delimiter=d))) - 1 for r in rows]
        if counts and (usual := max(set(counts), key=counts.count)) and (counts.count(usual), usual) > best:
            best, found = (counts.count(usual), usual), d
    return found


def csv_cells(files: DataFrame) -> DataFrame:
    """Rows of cells of delimited files, each with its own delimiter. Blank rows stay: they part regions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                text = raw.decode("utf-8-sig", "replace")
                rows = [(path, None, i, [c.strip() for c in r]) for i, r in enumerate(csv.reader(io.StringIO(text), delimiter=sniff(text[:4096])))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, CELLS)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sheet_rows(raw: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook: shared, inline and plain values as text."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for row in root.iter(f"{_SHEET}row"):
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [""] * (at - 1 - len(cells) if at else 0)
                v = c.find(f"{_SHEET}v")
                value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            yield sheet.get("name"), int(row.get("r", "0")) - 1, cells


def xlsx_cells(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(path, *r) for r in sheet_rows(raw)], columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def used_range(cells: DataFrame, by: list[str]) -> DataFrame:
    """First and last row and column with a value, as numbers and as a label such as B2:D5."""
    from docweave.functions.text import column_name

    flat = cells.select(*by, "row_no", F.posexplode("cells").alias("col_no", "v")).filter(F.trim("v") != "")
    r = flat.groupBy(*by).agg(F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"), F.min("col_no").alias("col_start"), F.max("col_no").alias("col_end"))
    label = F.concat(column_name(F.col("col_start")), (F.col("row_start") + 1).cast("string"), F.lit(":"), column_name(F.col("col_end")), (F.col("row_end") + 1).cast("string"))
    return r.withColumn("used_range", label)


def table_regions(cells: DataFrame, by: list[str]) -> DataFrame:
    """Tables of a sheet: runs of rows that are not blank, as Markdown, with their rows and whether the first is a header."""
    from docweave.operators import splitting

    blank = F.forall("cells", lambda c: F.trim(c) == "")
    runs = splitting.islands(cells, by, "row_no", blank, "region")
    t = runs.groupBy(*by, "region").agg(F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"), F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"]).alias("rows"))
    width = F.array_max(F.transform("rows", F.size))
    padded = F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    t = t.withColumn("rows", padded)
    header = F.when(F.size("rows") > 1, splitting.header_votes(F.get("rows", F.lit(0)), F.get("rows", F.lit(1)))).otherwise(False)
    return t.select(*by, "region", "row_start", "row_end", header.alias("has_header"), splitting.table_markdown(F.col("rows")).alias("text"))


def document_elements(raw: bytes) -> Iterator[tuple[str, str, int | None]]:
    """(kind, text, level) of a word-processing document's body in order; list paragraphs that follow each other are one
    element, tables are Markdown."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_WORD}body")
    items: list[str] = []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    for e in body:
        if e.tag == f"{_WORD}p":
            text = text_of(e)
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = style.get(f"{_WORD}val", "") if style is not None else ""
            heading = re.fullmatch(r"(?:heading|标题)\s*([1-9])", name, re.IGNORECASE)
            listed = e.find(f"{_WORD}pPr/{_WORD}numPr") is not None or name.lower().startswith("list")
            if listed and text:
                items.append(f"- {text}")
                continue
        if items:
            yield "list", "\n".join(items), None
            items = []
        if e.tag == f"{_WORD}p" and text:
            yield ("heading", text, int(heading[1])) if heading else ("paragraph", text, None)
        elif e.tag == f"{_WORD}tbl":
            rows = [[" ".join(text_of(c).split()).replace("|", "\\|") for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                yield "table", "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]), None
    if items:
        yield "list", "\n".join(items), None


def docx_elements(files: DataFrame) -> DataFrame:
    """path, n, kind, text, level, heading_path of word-processing files."""
    from docweave.operators.splitting import with_heading_paths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(path, n, *e) for n, e in enumerate(document_elements(raw))], columns=["path", "n", "kind", "text", "level"]).astype({"level": "Int32"})

    return with_heading_paths(files.select("path", "content").mapInPandas(run, "path string, n int, kind string, text string, level int"), "path", "n")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, title string, text string").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance from three or four tab-separated columns, with or without a header."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    n = F.size("p")
    return parts.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", n - 2).alias("doc_id"), F.expr("try_cast(get(p, size(p) - 1) as int)").alias("relevance")).filter("relevance is not null")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; what is missing gets its default."""
    one = "case_id string, category string, query string, expected_chunk_ids array<long>, notes string"
    raw = spark.read.schema(f"version string, description string, cases array<struct<{one.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    c = raw.select(F.explode("cases").alias("c")).select("c.*")
    return c.withColumns({"category": F.coalesce("category", F.lit("factual")), "expected_chunk_ids": F.coalesce("expected_chunk_ids", F.array().cast("array<long>")), "notes": F.coalesce("notes", F.lit(""))})
