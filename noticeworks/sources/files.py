"""Readers of notices' files: line caches, sniffed attachments, spreadsheets and word documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text, trim

LINES = "sourceUrl string, lineCount long, fetchedAt string, lines array<string>"
#: Rows that a parser hands over at once; a table for each file costs more than its parsing.
AT_ONCE = 5_000
CELLS = "path string, sheet string, row int, cells array<string>, error string"


def read_line_cache(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(source_url, line_no, line): the lines of cached pages; broken or empty files give none.

    multi_line: each file is one record over many lines; else each line is one, as write_line_cache has it.
    """
    cached = spark.read.schema(LINES).option("multiLine", multi_line).json(path)
    return cached.select(F.col("sourceUrl").alias("source_url"), F.posexplode("lines").alias("line_no", "line"))


def write_line_cache(lines: DataFrame, path: str) -> None:
    """Lines (source_url, line_no, line) as one cache record per source."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    record = lines.groupBy(F.col("source_url").alias("sourceUrl")).agg(ordered.alias("lines"))
    record.select("sourceUrl", F.size("lines").cast("long").alias("lineCount"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("fetchedAt"), "lines").write.mode("overwrite").json(path)


def sniff(content: Column) -> Column:
    """zip, ole2, pdf, text or unknown, by the first bytes; text is UTF-8 with at least one ideograph in 8 KiB."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    plain = F.length(F.regexp_replace(start, r"[^\x09\x0A\x0D\x20-\x7E\x80-\xFF]", "")) > 0.92 * F.length(start)
    ideograph = start.rlike(r"[\xE4-\xE9][\x80-\xBF][\x80-\xBF]")
    return F.when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole2").when(head.startswith("255044462D"), "pdf").when(plain & ideograph, "text").otherwise("unknown")


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(digits) - 1, column - 1


def _sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Every sheet's rows, blank ones too, as wide as its cells, merged areas and stated dimension reach.

    A merged area has its value in its first cell. A sheet of no more than its first cell, and without a dimension, has no rows.
    """
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")]
        files = sorted((f for f in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", f)), key=lambda f: int(re.search(r"\d+", f)[0]))
        for name, file in zip(names, files, strict=False):
            found: dict[tuple[int, int], str] = {}
            sheet = ElementTree.fromstring(z.read(file))
            for c in sheet.iter(f"{{{ns['m']}}}c"):
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                value = "".join(x.text or "" for x in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "") if v is not None else ""
                found[_place(c.get("r"))] = shared[int(value)] if c.get("t") == "s" and value else value
            areas = [a.get("ref") for tag in ("dimension", "mergeCell") for a in sheet.iter(f"{{{ns['m']}}}{tag}") if a.get("ref")]
            reached = [*found, *[_place(a.rpartition(":")[2].replace("$", "")) for a in areas]]
            rows, columns = (max((p[i] for p in reached), default=-1) + 1 for i in (0, 1))
            if (rows, columns) == (1, 1) and sheet.find("m:dimension", ns) is None:
                rows = 0
            yield name, [[found.get((r, c), "") for c in range(columns)] for r in range(rows)]


def _paragraphs(content: bytes) -> list[str]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ["".join(x.text or "" for x in p.iter(f"{w}t")) for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{w}p")]


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """parse_office of all files at a path."""
    return parse_office(spark.read.format("binaryFile").load(path))


def sheet_texts(rows: DataFrame) -> DataFrame:
    """path, sheet, text: each sheet's rows as lines of cells between tabs, tabs at the end of a line left out."""
    cells = F.transform("cells", lambda c: trim(F.regexp_replace(text(c), r'^"|"\z', "")))
    line = F.regexp_replace(F.array_join(cells, "\t"), "\t+\\z", "")
    lines = F.array_sort(F.collect_list(F.struct("row", line.alias("line"))))
    return rows.filter("error is null").groupBy("path", "sheet").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def parse_office(files: DataFrame) -> DataFrame:
    """path, sheet, row, cells, error: the rows of spreadsheets and the paragraphs (one cell) of documents; files: path and content.

    A file that can't be read gives one row with the reason; older binary formats and PDF are unsupported_format.
    """

    def table(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"]).astype({"row": "Int32"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    if r.path.lower().endswith(".xlsx"):
                        rows = [(r.path, s, i, c, None) for s, cells in _sheets(r.content) for i, c in enumerate(cells)]
                    elif r.path.lower().endswith(".docx"):
                        rows = [(r.path, "", i, [p], None) for i, p in enumerate(_paragraphs(r.content))]
                    else:
                        rows = [(r.path, None, None, None, "unsupported_format")]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, IndexError) as e:
                    rows = [(r.path, None, None, None, type(e).__name__)]
                held += rows
                if len(held) >= AT_ONCE:
                    yield table(held)
                    held = []
        if held:
            yield table(held)

    return files.select("path", "content").mapInPandas(parse, CELLS)
