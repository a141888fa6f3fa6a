"""Readers for the formats that public records come in. Spark lists and splits the files; a task parses whole small files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every cell a string, so that rules decide what a number is; bad rows stop the run."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8").filter(F.coalesce(*columns).isNotNull())


def json_shards(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON files named after a key inside; a file whose name and key differ stops the run."""
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select("*", F.regexp_extract("_metadata.file_name", r"([^/]+)\.json$", 1).alias("_stem"))
    checked = F.when(F.col("_stem") == F.col(key).cast("string"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("file name and key differ: "), "_stem")).cast(schema[key].dataType))
    return rows.withColumn(key, checked).drop("_stem")


def pattern_lines(spark: SparkSession, path: str, pattern: str, names: list[str], least: int = 0) -> DataFrame:
    """Lines of a text that a pattern matches, its groups as columns; fewer than expected stop the run."""
    lines = spark.read.text(path)
    rows = lines.filter(F.col("value").rlike(pattern)).select(*(F.trim(F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)))
    if least and rows.count() < least:
        raise ValueError(f"fewer than {least} lines match")
    return rows


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")


def _per_file(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(schema)] if hasattr(T.StructType, "fromDDL") else [c.split()[0] for c in schema.split(", ")]

    def read(frames):
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                rows = [(file, *r) for r in parse(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return _files(spark, path).mapInPandas(read, schema)


_SHEET = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


def parse_sheets(content: bytes) -> list[tuple[str, int, dict[str, str]]]:
    """(sheet, row, column letter -> text) of every sheet of a workbook, in its order; sheets of a book without a list are named after their files."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = z.namelist(), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _SHEET)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _SHEET)]
        files = {n.rpartition("/")[2].removesuffix(".xml"): n for n in sorted(names) if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)}
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            of = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iterfind("p:Relationship", _SHEET)}
            listed = [(s.get("name"), of.get(s.get(f"{{{_SHEET['r']}}}id"), "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _SHEET)]
            files = {name: target.lstrip("/") if target.startswith("/") else f"xl/{target}" for name, target in listed}
        sheets = [(name, ElementTree.fromstring(z.read(file))) for name, file in files.items() if file in names]
    out = []
    for name, sheet in sheets:
        for row in sheet.iterfind(".//m:row", _SHEET):
            cells = {}
            for c in row.iterfind("m:c", _SHEET):
                v, inline = c.find("m:v", _SHEET), c.find("m:is", _SHEET)
                text = "".join(t.text or "" for t in inline.iterfind(".//m:t", _SHEET)) if inline is not None else (v.text if v is not None else None)
                if text is not None:
                    cells[re.match("[A-Z]+", c.get("r"))[0]] = shared[int(text)] if c.get("t") == "s" else text
            out.append((name, int(row.get("r")), cells))
    return out


def xlsx_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of all sheets of workbooks."""
    return _per_file(spark, path, parse_sheets, "file string, sheet string, row int, cells map<string,string>")


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, cells) of each workbook's first sheet."""

    def first(content: bytes):
        rows = parse_sheets(content)
        return [r[1:] for r in rows if r[0] == rows[0][0]]

    return _per_file(spark, path, first, "file string, row int, cells map<string,string>")


def zipped_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML members of ZIP files, each as text; parse them with from_xml and a schema."""

    def parse(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".xml")]

    return _per_file(spark, path, parse, "file string, member string, xml string")


def xml_rows(members: DataFrame, schema: str) -> DataFrame:
    return members.select("file", "member", F.from_xml("xml", schema).alias("x")).select("file", "member", "x.*")


def parse_yaml(text: str):
    """The YAML that record files use: nested maps and lists by indent, plain and quoted scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]
    value, rest = _yaml_block(lines, 0)
    if rest != len(lines):
        raise ValueError(f"can't read {lines[rest][1]!r}")
    return value


def _scalar(text: str):
    if text[:1] == text[-1:] and text[:1] in ("'", '"') and len(text) > 1:
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) and not re.fullmatch(r"0\d+", text) else text


def _yaml_block(lines: list[tuple[int, str]], at: int):
    indent, first = lines[at]
    is_list = first.startswith("- ") or first == "-"
    out = [] if is_list else {}
    while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("-") == is_list):
        text = lines[at][1]
        if is_list:
            inner = text[1:].strip()
            if ":" in inner and not inner.startswith(("'", '"')) and re.match(r"[\w.-]+:( |$)", inner):
                lines[at] = (indent + 2, inner)  # a map that starts beside its dash
                value, at = _yaml_block(lines, at)
            elif inner:
                value, at = _scalar(inner), at + 1
            else:
                value, at = _yaml_block(lines, at + 1)
            out.append(value)
            continue
        key, _, inner = text.partition(":")
        inner, at = inner.strip(), at + 1
        nested = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-")))
        if inner or not nested:
            out[_scalar(key)] = _scalar(inner)
        else:
            out[_scalar(key)], at = _yaml_block(lines, at)
    return out, at


def yaml_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of YAML lists, by a schema; records of maps of lists get their map key as _key."""
    import json

    def parse(content: bytes):
        doc = parse_yaml(content.decode())
        pairs = ((None, r) for r in doc) if isinstance(doc, list) else ((k, r) for k, rows in doc.items() for r in rows)
        return [(None if k is None else str(k), json.dumps(r)) for k, r in pairs]

    texts = _per_file(spark, path, parse, "file string, _key string, record string")
    return texts.select("file", "_key", F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "_key", "r.*")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells) of every table in a column of pages."""

    def read(frames):
        for frame in frames:
            out = []
            for k, page in zip(frame[key], frame[html], strict=True):
                parser = _Tables()
                parser.feed(page or "")
                out += [(k, t, r, cells) for t, rows in enumerate(parser.tables) for r, cells in enumerate(rows)]
            if out:
                yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(read, f"{key} {pages.schema[key].dataType.simpleString()}, table_no int, row_no int, cells array<string>")


def country_lines(lines: DataFrame, key: list[str], order: str, text: str, numbers: int) -> DataFrame:
    """Rows "name n n n" of a text table; a name that wraps is joined from the line before; the Total row is marked."""
    from pyspark.sql.window import Window as W

    figures = r"^(.*?)\s*((?:[\d,]+\s+){%d}[\d,]+)\s*$" % (numbers - 1)
    by = W.partitionBy(*key).orderBy(order)
    split_ = lines.withColumns({"_name": F.trim(F.regexp_extract(text, figures, 1)), "_n": F.regexp_extract(text, figures, 2), "_before": F.lag(text).over(by)})
    split_ = split_.withColumn("_wraps", F.lag((F.col("_n") == "") & F.trim(text).rlike("^[A-Za-z,.' -]+$")).over(by))
    name = F.trim(F.when(F.col("_wraps"), F.concat_ws(" ", F.trim("_before"), "_name")).otherwise(F.col("_name")))
    values = F.transform(F.split(F.trim("_n"), r"\s+"), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))
    return split_.filter("_n <> ''").select(*key, order, name.alias("name"), values.alias("numbers"), (F.lower(name) == "total").alias("is_total"))


def table_value(text, label: str, column: int):
    """The number in a column of the row "label | n | n" of a text."""
    row = F.regexp_extract(text, rf"(?m)^\s*{re.escape(label)}\s*\|(.*)$", 1)
    return F.replace(F.trim(F.get(F.split(row, r"\|"), F.lit(column))), F.lit(","), F.lit("")).try_cast("double")


def wiki_entries(pages: DataFrame, key: str, text: str) -> DataFrame:
    """List entries of wikitext: linked title, volume, page and year."""
    pattern = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\][^\n]*?(\d{1,3})\s+U\.S\.\s+(\d{1,4})[^\n]*?\((\d{4})\)"
    entry = F.explode(F.regexp_extract_all(text, F.lit(rf"(\*[^\n]*{pattern}[^\n]*)"), F.lit(1))).alias("entry")
    rows = pages.select(key, entry)
    return rows.select(key, *(F.regexp_extract("entry", pattern, i + 1).cast(kind).alias(n) for i, (n, kind) in enumerate((("title", "string"), ("volume", "int"), ("page", "int"), ("year", "int")))))


#: What a location workbook prints for a number that it doesn't give.
SUPPRESSED, NOT_GIVEN = ("*", "(s)"), ("N/A", "-", "")


def tri_state(cell):
    """A cell as (state, n): a suppressed number never becomes 0."""
    text = F.trim(cell)
    state = F.when(text.isin(*SUPPRESSED), "suppressed").when(text.isNull() | text.isin(*NOT_GIVEN), F.lit(None)).otherwise("value")
    return F.struct(state.alias("state"), F.when(state == "value", F.replace(text, F.lit(","), F.lit("")).cast("long")).alias("n"))


def recount(spark: SparkSession, path: str, column: int) -> DataFrame:
    """A second, independent reading of a CSV file by positions: rows for each value of a column, to hold against the first."""

    def count(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"))))[1:]
                yield pd.Series([r[column] for r in rows if any(r)], dtype=str).value_counts().rename_axis("value").reset_index(name="n")

    return _files(spark, path).mapInPandas(count, "value string, n long").groupBy("value").agg(F.sum("n").alias("n"))
