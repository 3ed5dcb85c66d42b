"""Jobs of workbooks that are made of generated sheets; with equal SQL, which never sees the files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources import files
from . import tables as P
from .catalog import query
from .generated import Made

ROWS = [r for r in P.ROWS if r.count("\n") == 1]
HEADERS = [h for h in P.HEADERS if "\n" in h]
BOOKS = Made("customer", "c_custkey", body=(["", "2026年招聘岗位表\n", "\n\n"], HEADERS, ROWS, ROWS, ROWS, ["", "\n说明：以上\n"]), second=(["", ""], HEADERS, ROWS, ROWS), broken=([False] * 6 + [True],))
NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(sheets: list[str]) -> bytes:
    """A workbook with a sheet for each text, of inline strings; the first row of the first sheet is merged to the last column."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}"><sheets>{"".join(f"""<sheet name="s{i}"/>""" for i in range(len(sheets)))}</sheets></workbook>')
        for i, text in enumerate(sheets):
            lines = [line.split("\t") for line in text.split("\n")]
            rows = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(line) if v) + "</row>" for r, line in enumerate(lines))
            last = chr(64 + max(map(len, lines)))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{NS}"><dimension ref="A1:{last}{len(lines)}"/><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:{last}1"/></mergeCells></worksheet>')
    return out.getvalue()


def _books(spark, sf_dir):
    @F.pandas_udf("binary")
    def made(first: pd.Series, second: pd.Series, broken: pd.Series) -> pd.Series:
        return pd.Series([b"no archive" if x else workbook([a, b]) for a, b, x in zip(first, second, broken, strict=True)])

    return BOOKS.rows(spark, sf_dir).select("id", F.concat(F.lit("b"), "id", F.lit(".xlsx")).alias("path"), made("body", "second", "broken").alias("content"))


WIDE = f"""raw AS (
  SELECT id * 2 + k AS id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS row_no
  FROM (SELECT id, 0 AS k, body FROM {BOOKS.sql} AS b WHERE NOT broken UNION ALL SELECT id, 1, second FROM {BOOKS.sql} AS b WHERE NOT broken)),
cut AS (SELECT id, row_no, {P._cells('line')} AS cells FROM raw),
sheet_rows AS MATERIALIZED (
  SELECT id, row_no, cells || list_transform(range(greatest(max(len(cells)) OVER (PARTITION BY id) - len(cells), 0)), lambda i: '') AS cells FROM cut)"""


@query(f"""
WITH RECURSIVE {WIDE}, {P.LAYOUT}, {P.MEND}, {P.JOBS}
SELECT 'b' || (id // 2) || '.xlsx' AS path, 's' || (id % 2) AS sheet, row_no::INT AS row, job_id, title, slots, coalesce(nullif(education, ''), '—') AS education, major, other, NULL AS error FROM named
UNION ALL SELECT 'b' || id || '.xlsx', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'BadZipFile' FROM {BOOKS.sql} AS b WHERE broken""")
def workbook_jobs(spark, sf_dir):
    """Jobs of all sheets of workbooks with merged cells; files that can't be read are rows with the reason."""
    rows = files.parse_office(_books(spark, sf_dir))
    good = rows.filter("error is null").select("path", "sheet", F.col("row").alias("row_no"), "cells")
    jobs = T.jobs(T.mended_rows(good, ["path", "sheet"]))
    found = jobs.select("path", "sheet", F.col("row_no").alias("row"), F.col("id").alias("job_id"), "title", "slots", "education", "major", "other", F.lit(None).cast("string").alias("error"))
    bad = rows.filter("error is not null").select("path", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[1:-1]], "error")
    return found.union(bad)


@query(f"""
WITH {WIDE}
SELECT 'b' || (id // 2) || '.xlsx' AS path, 's' || (id % 2) AS sheet, string_agg(regexp_replace(line, '\\t+$', ''), chr(10) ORDER BY row_no) AS text
FROM (SELECT id, row_no, array_to_string(list_transform(string_split(line, chr(9)), lambda c: trim(regexp_replace(c, '^"|"$', '', 'g'))), chr(9)) AS line FROM raw) GROUP BY id""")
def workbook_texts(spark, sf_dir):
    """Sheets as tab-separated lines."""
    return files.sheet_texts(files.parse_office(_books(spark, sf_dir)))
