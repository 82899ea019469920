import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gapline.sources import files
from gapline.streaming import imports as stream


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Review" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Place Name</t></si><si><t>Rating</t></si><si><t>Toba</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><f>2+2</f><v>4</v></c></row><row r="3"><c r="B3" t="e"><v>#REF!</v></c></row></sheetData></worksheet>')
    return str(path)


def test_workbook(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx")
    assert str(files.first_workbook(str(tmp_path))) == path
    rows = files.load_sheets(spark, path)["Review"].collect()
    assert [tuple(r) for r in rows] == [(2, "Toba", "4"), (3, None, "#REF!")]
    spark.dataSource.register(files.WorkbookSource)
    cells = spark.read.format("workbook_cells").load(path)
    assert {(r.row_no, r.column_no, r.issue) for r in files.cell_issues(cells).collect()} == {(1, 1, "formula"), (2, 1, "error")}


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿review_id,text\nr1,\nr2,\"a, \"\"b\"\"\"\n".encode())
    df = files.read_delimited(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in df.orderBy("review_id").collect()] == [("r1", ""), ("r2", 'a, "b"')]
    assert files.read_delimited(spark, str(tmp_path / "x.csv"), ["review_id"]).columns == ["review_id"]


def test_upload(spark, tmp_path):
    df = files.read_upload(spark, "new.CSV", "Review Text;Review-Rating\nbagus é;5\n".encode("latin-1"))
    assert [tuple(r) for r in df.collect()] == [(2, "bagus é", "5")]
    assert df.columns == ["row_no", "review_text", "review_rating"]
    for name, data in (("x.txt", b"a"), ("x.csv", b""), ("x.csv", b"only,head\n"), ("x.csv", b"a\n" + b"1\n" * 5001)):
        with pytest.raises(ValueError):
            files.read_upload(spark, name, data)


def test_sheet_spec(spark):
    spec = files.SheetSpec("kuliner", {"place_name": "nama", "price": "harga"}, "kuliner")
    df = spark.createDataFrame([(2, "Warung")], "row_no long, nama string")
    assert spec.apply(df).first().asDict() == {"row_no": 2, "place_name": "Warung", "price": None, "source_sheet": "kuliner", "category": "kuliner"}


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([(99.0, 2.0, "a")], "x double, y double, name string").withColumn("properties", F.struct("name"))
    got = json.loads(files.write_geojson(f, str(tmp_path / "m.geojson")).read_text())
    assert got["features"] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [99.0, 2.0]}, "properties": {"name": "a"}}]
    files.write_run(spark.range(3), str(tmp_path / "runs"), "imp-1")
    assert {r.import_id for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {"imp-1"}
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_run(spark.range(3), str(tmp_path / "runs"), "imp-1")
    with pytest.raises(ValueError):
        files.write_run(spark.range(3), str(tmp_path / "runs"), "../x")
    files.write_report(str(tmp_path / "r.json"), {"n": 1, "day": datetime.date(2024, 1, 1)})
    assert files.load_settings(str(tmp_path / "r.json"), ("n",))["n"] == 1
    assert files.artifact_index({"r": str(tmp_path / "r.json"), "s": "/nothing"})[1]["exists"] is False


def test_streamed_import(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"row_no": 2, "place_name": "P", "place_category": "c", "review_text": "sangat bagus", "review_rating": 5.0}
    (src / "a.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"row_no": 3, "review_text": "x"}) + "\n")
    run = lambda: stream.start(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "b.json").write_text(json.dumps(row | {"review_text": "kurang bersih", "review_rating": 1.0}) + "\n")
    run()
    run()
    got = stream.published(spark, str(tmp_path / "out")).collect()
    assert sorted((r.review_text, r.label) for r in got) == [("kurang bersih", "negative"), ("sangat bagus", "positive")]
