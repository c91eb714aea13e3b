"""Files and sinks on small files made here."""

import io
import zipfile

from pyspark.sql import functions as F

import pytest

from docweave.sources import files, sinks


def office(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


def test_csv_regions(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order;amount\n1;2,5\n2;3\n\nx;y\nz;w\n")
    f = files.read_files(spark, str(tmp_path))
    t = files.table_regions(files.csv_cells(f), ["path"]).orderBy("region").collect()
    assert [(r.row_start, r.row_end, r.has_header) for r in t] == [(0, 2, True), (4, 5, True)]
    assert t[0].text == "| order | amount |\n| --- | --- |\n| 1 | 2,5 |\n| 2 | 3 |"


def test_workbook_and_used_range(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = office(
        {
            "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {ns}><si><t>name</t></si><si><t>n</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>a</t></is></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>',
        }
    )
    (tmp_path / "b.xlsx").write_bytes(book)
    f = files.read_files(spark, str(tmp_path))
    cells = files.xlsx_cells(f)
    assert [tuple(r.cells) for r in cells.orderBy("row_no").collect()] == [("", "name", "n"), ("", "a", "7")]
    assert files.used_range(cells, ["path", "sheet"]).first().used_range == "B2:C3"
    assert f.select(files.type_matches(F.col("file_type"), F.col("content")).alias("ok"), files.zip_problem("content", "file_type").alias("p")).first()[:] == (True, None)


def test_word_document(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="", num=False: f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{"<w:numPr/>" if num else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Title", "Heading1") + p("Text.") + p("a", num=True) + p("b", num=True) + p("Sub", "Heading2") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    (tmp_path / "d.docx").write_bytes(office({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"}))
    e = files.docx_elements(files.read_files(spark, str(tmp_path))).orderBy("n").collect()
    assert [(r.kind, r.text) for r in e] == [("heading", "Title"), ("paragraph", "Text."), ("list", "- a\n- b"), ("heading", "Sub"), ("table", "| x |\n| --- |")]
    assert e[4].heading_path == ["Title", "Sub"]


def test_bad_files(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(office({"../evil": "x"}))
    (tmp_path / "y.docx").write_bytes(b"no zip")
    (tmp_path / "z.txt").write_bytes(b"\xff\xfe")
    f = files.read_files(spark, str(tmp_path))
    problems = {r.path[-6:]: r.p for r in f.filter("file_type = 'docx'").select("path", files.zip_problem("content", "file_type").alias("p")).collect()}
    assert problems == {"x.docx": "unsafe path", "y.docx": "not a zip"}
    assert files.decode_text(f.filter("file_type = 'txt'")).select("valid", "text").first()[:] == (False, None)


def test_qrels_and_cases(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\n")
    (tmp_path / "t.tsv").write_text("1\t0\tb\t2\n")
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path)).orderBy("doc_id").collect()] == [("1", "a", 1), ("1", "b", 2)]
    (tmp_path / "c.json").write_text('{"version": "1", "cases": [{"case_id": "x", "query": "q"}]}')
    assert files.read_cases(spark, str(tmp_path / "c.json")).first().asDict() == {"case_id": "x", "category": "factual", "query": "q", "expected_chunk_ids": [], "notes": ""}


def test_versions_and_frames(spark, tmp_path):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "knowledge_base_id long, content string")
    base = str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, base)
    sinks.reindex(c, base, 1)
    assert sinks.read_current(spark, base).count() == 2
    sinks.reindex(c.limit(1), base, 2)
    assert sinks.read_current(spark.newSession(), base).count() == 1
    sinks.activate(spark, base, 1)
    assert sinks.read_current(spark, base).count() == 2
    f = sinks.event_frames(spark.createDataFrame([("t", 0, "answer", "a\nb")], "thread string, n int, event string, data string")).first().frame
    assert f == "event: answer\ndata: a\ndata: b\n\n"
