import io
import zipfile

from pyspark.sql import functions as F

from noticeworks.sources import files
from noticeworks.streaming import ingest

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return b.getvalue()


def test_office_files(spark, tmp_path):
    sheet = f'<worksheet {M}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    book = archive({"xl/workbook.xml": f'<workbook {M}><sheets><sheet name="岗位"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {M}><si><t>名</t><r><t>称</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "a.xlsx").write_bytes(book)
    (tmp_path / "b.docx").write_bytes(archive({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> line</w:t></w:r></w:p><w:p/></w:body></w:document>"}))
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.xlsx").write_bytes(archive({"other": "x"}))
    got = {(r.path[-6:], r.row): (r.cells, r.error) for r in files.read_office(spark, str(tmp_path)).collect()}
    assert got["a.xlsx", 0] == (["名称", "", "x"], None) and got["a.xlsx", 1] == (["", "", ""], None) and got["a.xlsx", 2] == (["", "7", ""], None)
    assert got["b.docx", 0] == (["one line"], None) and got["b.docx", 1] == ([""], None)
    assert got["c.xlsx", None][1] == "BadZipFile" and got["d.pdf".rjust(6, "/"), None][1] == "unsupported_format" and got["e.xlsx", None][1]
    kinds = {r.path.rpartition("/")[2][0]: r.kind for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path", files.sniff(F.col("content")).alias("kind")).collect()}
    assert kinds["a"] == "zip" and kinds["d"] == "pdf" and kinds["c"] == "unknown"


def test_sniff(spark):
    rows = [("招聘公告 with text".encode(), "text"), (b"plain latin", "unknown"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "ole2"), (b"", "unknown"), (None, "unknown")]
    df = spark.createDataFrame(rows, "content binary, expected string")
    assert all(r.kind == r.expected for r in df.select("expected", files.sniff(F.col("content")).alias("kind")).collect())


def test_line_cache_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("u", 0, "first"), ("u", 1, "second"), ("v", 0, "other")], "source_url string, line_no int, line string")
    files.write_line_cache(lines, str(tmp_path / "cache"))
    assert sorted(map(tuple, files.read_line_cache(spark, str(tmp_path / "cache"), multi_line=False).collect())) == sorted(map(tuple, lines.collect()))
    (tmp_path / "one.json").write_text('{"sourceUrl": "w",\n "lines": ["a",\n "b"]}')
    (tmp_path / "broken.json").write_text('{"sourceUrl"')
    assert sorted(map(tuple, files.read_line_cache(spark, str(tmp_path / "*.json")).collect())) == [("w", 0, "a"), ("w", 1, "b")]


def test_windows_over_a_stream(spark, sf_small):
    stream = ingest.windowed(ingest.read_files(spark, sf_small, "events"), "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    got = ingest.run_available(stream, "days", "complete")
    want = spark.read.parquet(f"{sf_small}/events.parquet").count()
    assert got.agg(F.sum("n")).first()[0] == want
