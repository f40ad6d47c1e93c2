"""Readers and writers: CSV quoting and encodings, workbooks, prompts, registry, naming."""
import io
import json
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weft.operators.columns import detect_text_column, require_columns, select_columns, with_result_column
from weft.sources import readers as RD
from weft.sources import sinks as SK


def write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_csv_bom_quotes_newlines_and_na(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    write(p, '\ufeffID,MESSAGE\r\n1,"say ""hi""\nthere"\r\n2,NA\r\n'.encode("utf-8"))
    df = RD.read_csv(spark, p, na_values=RD.DEFAULT_NA_VALUES)
    rows = df.orderBy("ID").collect()
    assert df.columns == ["ID", "MESSAGE"]
    assert rows[0].MESSAGE == 'say "hi"\nthere' and rows[1].MESSAGE is None


def test_csv_encoding_detection(spark, tmpdir_path):
    a, b = os.path.join(tmpdir_path, "u.csv"), os.path.join(tmpdir_path, "l.csv")
    write(a, "ID,MESSAGE\n1,café\n".encode("utf-8"))
    write(b, "ID,MESSAGE\n2,crème\n".encode("latin-1"))
    enc = RD.detect_encoding(spark, [a, b])
    assert sorted(enc.values()) == ["ISO-8859-1", "UTF-8"]
    got = {r.ID: r.MESSAGE for r in RD.read_csv(spark, [a, b]).collect()}
    assert got == {"1": "café", "2": "crème"}


def make_xlsx(rows):
    shared = []
    sheet_rows = []
    for r_i, row in enumerate(rows, 1):
        cells = []
        for c_i, v in enumerate(row):
            ref = f"{chr(65 + c_i)}{r_i}"
            if isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        sheet_rows.append(f'<row r="{r_i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(sheet_rows)}</sheetData></worksheet>')
    return buf.getvalue()


def test_workbooks(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "books")
    os.makedirs(folder)
    write(os.path.join(folder, "a.xlsx"), make_xlsx([["ID", "MESSAGE"], [1, "xin chào"], [2.0, "b"]]))
    write(os.path.join(folder, "b.xlsx"), make_xlsx([["ID", "MESSAGE"], [3, "c"]]))
    df = RD.read_workbooks(spark, folder)
    got = sorted((r.ID, r.MESSAGE) for r in df.collect())
    assert got == [("1", "xin chào"), ("2", "b"), ("3", "c")]


def test_workbooks_with_columns_in_another_order(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "my books")
    os.makedirs(folder)
    write(os.path.join(folder, "a.xlsx"), make_xlsx([["ID", "MESSAGE"], [1, "one"]]))
    write(os.path.join(folder, "b.xlsx"), make_xlsx([["MESSAGE", "NOTE", "ID"], ["two", "n", 2]]))
    got = RD.read_workbooks(spark, folder)
    assert sorted((r.ID, r.MESSAGE, r.NOTE) for r in got.collect()) == [("1", "one", None), ("2", "two", "n")]


def test_workbooks_keep_repeated_headers_and_take_the_first_sheet(spark, tmpdir_path):
    assert RD.distinct_names(["a", "a", None, "a.1", "a", None]) == ["a", "a.1", "col2", "a.1.1", "a.2", "col5"]
    folder = os.path.join(tmpdir_path, "books")
    os.makedirs(folder)
    write(os.path.join(folder, "a.xlsx"), make_xlsx([["ID", "NOTE", "NOTE"], [1, "first", "second"]]))
    # the workbook shows its tenth part first; by name the second would come before it
    book = io.BytesIO(make_xlsx([["ID"], [7]]))
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>ID</t></is></c></row><row r="2"><c r="A2"><v>{{}}</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(book, "a") as z:
        z.writestr("xl/worksheets/sheet2.xml", cell.format(2))
        z.writestr("xl/worksheets/sheet10.xml", cell.format(10))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Chart" r:id="x"/><sheet name="Z" r:id="t"/><sheet name="A" r:id="o"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="x" Target="chartsheets/sheet1.xml"/><Relationship Id="o" Target="worksheets/sheet2.xml"/><Relationship Id="t" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
    write(os.path.join(folder, "b.xlsx"), book.getvalue())
    got = RD.read_workbooks(spark, folder)
    assert got.columns == ["path", "row_idx", "ID", "NOTE", "NOTE.1"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [("1", "first", "second"), ("10", None, None)]
    os.makedirs(os.path.join(tmpdir_path, "none"))
    assert RD.read_workbooks(spark, os.path.join(tmpdir_path, "none")).columns == ["path", "row_idx"]


def test_csv_names_with_blanks_kinds_and_empty_files(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "dữ liệu + 100%")
    os.makedirs(folder)
    write(os.path.join(folder, "a 1.csv"), "ID,MESSAGE\n1,café\n".encode("utf-8"))
    write(os.path.join(folder, "b 2.csv"), 'ID,MESSAGE\n2,"two\nlines"\n'.encode("utf-8"))
    write(os.path.join(folder, "c%203.csv"), "MESSAGE,ID\ncrème,3\n".encode("latin-1"))
    write(os.path.join(folder, "empty.csv"), b"")
    assert {r.ID: r.MESSAGE for r in RD.read_csv(spark, folder).collect()} == {"1": "café", "2": "two\nlines", "3": "crème"}
    assert RD.read_csv(spark, os.path.join(folder, "empty.csv")).count() == 0
    assert RD.read_csv(spark, os.path.join(folder, "empty.csv"), schema="ID string").columns == ["ID"]


def test_latin_prompt(spark, tmpdir_path):
    write(os.path.join(tmpdir_path, "my prompt.txt"), "  r\u00e9sum\u00e9 of the text\n".encode("latin-1"))
    row = RD.read_prompts(spark, tmpdir_path).first()
    assert (row.name, row.prompt) == ("my prompt", "r\u00e9sum\u00e9 of the text")


def test_prompts_and_registry(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "multi.txt")
    write(p, "  Phân tích dữ liệu khách hàng\n\n".encode("utf-8"))
    row = RD.read_prompts(spark, p).first()
    assert row.name == "multi" and row.prompt == "Phân tích dữ liệu khách hàng" and row.ok
    reg = os.path.join(tmpdir_path, "reg.json")
    write(reg, json.dumps({"fine_tuned_models": {"m1": {"model_id": "x-1", "display_name": "M1", "training_date": "2025-01-01",
                                                        "requires_context": True, "prompt_context": {"template": "{input_text}"}}}}).encode())
    r = RD.read_model_registry(spark, reg).first()
    assert (r.name, r.model_id, r.requires_context, r.template) == ("m1", "x-1", True, "{input_text}")
    assert RD.read_model_registry(spark, os.path.join(tmpdir_path, "missing.json")).count() == 0


def test_load_dispatch(spark, tmpdir_path):
    with pytest.raises(ValueError):
        RD.load(spark, os.path.join(tmpdir_path, "x.xls"))
    with pytest.raises(ValueError):
        RD.load(spark, os.path.join(tmpdir_path, "x.doc"))


def test_names():
    when = datetime(2025, 1, 20, 8, 30, 0)
    assert SK.result_path("/d/data.csv", "csv", when) == "/d/data_ai_result_20250120_083000.csv"
    assert SK.result_path("/d/data.xlsx", "xlsx", when) == "/d/data_ai_result_20250120_083000.xlsx"
    assert SK.state_file_path("/d/data.csv") == "/d/data_checkpoint.csv"
    assert SK.result_path("/d/data.csv", "parquet", when).endswith(".parquet")


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", "b")], "ID long, TEXT string, AUTHOR string")
    assert detect_text_column(df) == "TEXT"
    assert select_columns(df, "3,1") == ["AUTHOR", "ID"]
    with pytest.raises(ValueError):
        select_columns(df, "0,9")
    with pytest.raises(ValueError):
        require_columns(df, ["TEXT", "X", "Y"])
    assert "AI_RESULT" in with_result_column(df).columns


def test_write_result_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 'a "q"\nb')], "ID long, MESSAGE string")
    out = os.path.join(tmpdir_path, "out")
    SK.write_result(df, out, "csv")
    back = RD.read_csv(spark, out).collect()
    assert back[0].MESSAGE == 'a "q"\nb'


def test_request_lines(spark):
    df = spark.createDataFrame([(7, "hello")], "k long, p string")
    line = SK.request_bodies(df, "p", "openai", "m", key="k").first().value
    obj = json.loads(line)
    assert obj["request_id"] == "7" and obj["body"]["messages"][0]["content"] == "hello"
    assert F is not None


def test_validate_file_path(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "in.csv")
    write(p, b"ID,MESSAGE\n1,a\n")
    assert RD.validate_file_path(spark, p) == (True, "File hợp lệ")
    assert RD.validate_file_path(spark, "")[0] is False
    assert RD.validate_file_path(spark, os.path.join(tmpdir_path, "nope.csv"))[1].startswith("File không tồn tại")
    q = os.path.join(tmpdir_path, "in.txt")
    write(q, b"x")
    assert RD.validate_file_path(spark, q)[1].startswith("Định dạng file không được hỗ trợ")


def test_detect_text_column_on_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m.csv")
    write(p, b"ID,DATE,NOTE\n1,2025-01-20,hello\n2,2025-01-21,world\n")
    df = RD.read_csv(spark, p)  # all columns are strings
    assert detect_text_column(df) == "ID"  # without types the first column wins
    # with the sampled schema ID is numeric; a date-looking column stays text, as in a pandas read -> DATE
    assert detect_text_column(df, RD.sample_schema(spark, p, ratio=1.0)) == "DATE"
    assert RD.load(spark, p).filter("NOTE IS NULL").count() == 0
    # a quoted field over two lines, whose second line alone would make NOTE a number
    q = os.path.join(tmpdir_path, "q.csv")
    write(q, b'ID,NOTE\n1,"a\n2,3"\n4,5\n')
    assert [f.dataType.simpleString() for f in RD.sample_schema(spark, q)] == ["int", "string"]
