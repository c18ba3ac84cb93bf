"""Files as they are uploaded, watch lists, exports."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import routing
from tallyweave.sources import files, sinks, watchlists

CSV = "Name,Company,Email\nAnn Roe,Acme LLC,a@x.org\nBo Li,Beta Ltd,b@x.org\n"


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize(
    ("name", "data"),
    [
        ("a.csv", CSV), ("bom.csv", "﻿" + CSV), ("crlf.csv", CSV.replace("\n", "\r\n")), ("semi.csv", CSV.replace(",", ";")), ("tab.tsv", CSV.replace(",", "\t")), ("pipe.txt", CSV.replace(",", "|")),
        ("titled.csv", "Export 2024,,\n1,,\n" + CSV), ("ragged.csv", CSV + "Cy Doe,Gamma\n"),
    ],
)
def test_text_tables(spark, tmp_path, name, data):
    df = files.read_table(spark, put(tmp_path, name, data))
    assert df.columns == ["Name", "Company", "Email"]
    assert [r["Name"] for r in df.collect()][:2] == ["Ann Roe", "Bo Li"]


def test_other_encodings(spark, tmp_path):
    df = files.read_table(spark, put(tmp_path, "l.csv", "Nombre,Ciudad\nJosé,Málaga\n".encode("cp1252")))
    assert df.collect()[0]["Nombre"] == "José"
    assert files.detected_encoding("é".encode()) == "utf-8" and files.detected_encoding(b"\x81\x8d") == "latin-1"


def test_types_by_their_bytes(spark, tmp_path):
    for name, data in (("a.csv", CSV), ("b.bin", b"\x89PNG\r\n"), ("c.json", "[]"), ("d", "plain"), ("e.gz", b"\x1f\x8b\x08"), ("f.xlsx", b"PK\x03\x04x")):
        put(tmp_path, name, data)
    found = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"), files.detected_type(F.col("content"), F.col("path")).alias("t"))
    assert {r["n"]: r["t"] for r in found.collect()} == {"a.csv": "csv", "b.bin": "png", "c.json": "json", "d": "txt", "e.gz": "gzip", "f.xlsx": "xlsx"}
    with pytest.raises(ValueError, match="png"):
        files.read_table(spark, str(tmp_path / "b.bin"))


def test_json_and_lists(spark, tmp_path):
    rows = [{"name": "A"}, {"name": "B"}]
    for name, data in (("l.json", rows), ("o.json", {"data": rows})):
        assert files.read_table(spark, put(tmp_path, name, json.dumps(data))).count() == 2
    assert [r["value"] for r in files.read_list(spark, put(tmp_path, "n.txt", "name\n\n A \nB\n")).collect()] == ["A", "B"]


def zipped(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), data)
    return buf.getvalue()


def test_zip(spark, tmp_path):
    df = files.read_table(spark, put(tmp_path, "a.zip", zipped(readme_md="x", in__a_csv=CSV)))
    assert df.columns == ["Name", "Company", "Email"] and df.count() == 2
    book = xlsx({"One": [["Name", "City"], ["Ann", "Rome"]]})
    assert files.read_table(spark, put(tmp_path, "b.zip", zipped(d_xlsx=book))).collect()[0]["City"] == "Rome"
    with pytest.raises(ValueError, match="no supported file"):
        files.read_table(spark, put(tmp_path, "c.zip", zipped(image_png=b"\x89PNG")))


@pytest.mark.parametrize(
    ("data", "columns", "rows"),
    [
        ("\n\nName,Company\nAnn Roe,Acme\nBo Li,Beta", ["Name", "Company"], [("Ann Roe", "Acme"), ("Bo Li", "Beta")]),
        ('"LastName, FirstName",Phone,Status\n"Roe, Ann",1,ok\n"Li, Bo",2,no\n', ["LastName, FirstName", "Phone", "Status"], [("Roe, Ann", "1", "ok"), ("Li, Bo", "2", "no")]),
        ('Name,Note\nAnn,"two\nlines"\nBo,one\n', ["Name", "Note"], [("Ann", "two\nlines"), ("Bo", "one")]),
        ("Name,City\nAnn,Rome\nBo,Oslo\n".encode("utf-16"), ["Name", "City"], [("Ann", "Rome"), ("Bo", "Oslo")]),
        ("Ann Roe\nBo Li\nCy Doe\n", ["name"], [("Ann Roe",), ("Bo Li",), ("Cy Doe",)]),
        ("company\nAcme\nBeta\n", ["company"], [("Acme",), ("Beta",)]),
        ("Name,City\nAnn,Rome,extra\nBo\n", ["Name", "City", "column_3"], [("Ann", "Rome", "extra"), ("Bo", None, None)]),
        (b"Name,Note\nAnn,\x93x\x94\n", ["Name", "Note"], [("Ann", "“x”")]),
    ],
)
def test_ordinary_uploads(spark, tmp_path, data, columns, rows):
    df = files.read_table(spark, put(tmp_path, "u.csv", data))
    assert df.columns == columns and [tuple(r) for r in df.collect()] == rows


def test_many_files_at_once_and_the_log_of_failures(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.csv", CSV), ("empty.csv", b""), ("b.png", b"\x89PNG\r\n"), ("c.json", json.dumps({"total": 2, "people": [{"name": "A"}, {"name": "B", "age": 3}]})), ("broken.xlsx", b"PK\x03\x04x"), ("old.xls", b"\xd0\xcf\x11\xe0")):
        put(folder, name, data)
    table = files.ingested(spark, str(folder))
    got = {r["name"]: (r["n"], r["error"] is None) for r in table.groupBy(F.regexp_extract("path", "([^/]+)$", 1).alias("name")).agg(F.count("cells").alias("n"), F.max("error").alias("error")).collect()}
    assert got == {"a.csv": (2, True), "empty.csv": (0, False), "b.png": (0, False), "c.json": (2, True), "broken.xlsx": (0, False), "old.xls": (0, False)}
    files.log_failures(table, str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert len(log) == 4 and all(r["error"] for r in log) and {r["head"] for r in log} >= {"89504e470d0a", "d0cf11e0"}


def xlsx(sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cells = lambda r: "".join(f'<c r="{chr(65 + k)}1" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v is not None)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{cells(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    return buf.getvalue()


def test_workbooks(spark, tmp_path):
    people = [["Name", "City"], *[[f"Person {i}", None if i == 1 else "Rome"] for i in range(20)]]
    data = xlsx({"Meta": [["Key", "Value"], ["a", "1"]], "One": people, "Two": [["Name", "City", "More"], *[[f"Other {i}", "Oslo", "x"] for i in range(20)]], "Empty": []})
    df = files.read_table(spark, put(tmp_path, "w.xlsx", data))
    assert df.columns == ["Name", "City", "More"] and df.count() == 40
    assert df.where("Name = 'Person 1'").collect()[0]["City"] is None


def test_column_choice(spark):
    df = spark.createDataFrame([("1", "Ann Roe"), ("2", "Bo Li")], "id string, who string")
    assert files.best_column(df) == ("who", "content")
    assert files.best_column(df.withColumnRenamed("id", "Company Name")) == ("Company Name", "name")
    assert [r["original"] for r in files.names_of(df).collect()] == ["Ann Roe", "Bo Li"]


def test_routes(spark):
    df = lambda schema, *rows: spark.createDataFrame(rows, schema)
    assert routing.inspect(df("`First Name` string, `Last Name` string", ("A", "B"))).dataset_type == "PERSON"
    assert routing.inspect(df("vendor string, amount long", ("A", 1))).effective_mode == "company"
    assert routing.inspect(df("name string", ("Acme LLC",), ("Beta Ltd",))).decision == "company_dataset"
    assert routing.inspect(df("a long, b double", (1, 2.0))).decision == "invalid_dataset"
    assert routing.inspect(spark.createDataFrame([], "a string")).decision == "empty_dataset"
    assert routing.inspect(df("k string", ("whatever it is",))).dataset_type == "MIXED"


def test_watch_lists(spark, tmp_path):
    csv = watchlists.read_csv_list(spark, put(tmp_path, "w.csv", "id,canonical_name,aliases,dob\n1,Ann Roe,Annie| A. Roe|,1970\n2,Bo Li,,\n")).collect()
    assert csv[0]["aliases"] == ["Annie", "A. Roe"] and csv[1]["aliases"] == []
    sdn = put(tmp_path, "s.csv", '7,"ROE, Ann",individual,,,,,,,,,"DOB 01 Jan 1970; a.k.a. \'ANNIE\'; POB Rome"\n8,BOAT,vessel,,,,,,,,,\n')
    (row,) = watchlists.read_sdn(spark, sdn).collect()
    assert (row["canonical_name"], row["aliases"], row["dob"]) == ("ROE, Ann", ["ANNIE"], "01 Jan 1970")
    un = put(tmp_path, "u.xml", "<L><INDIVIDUALS><INDIVIDUAL><DATAID>5</DATAID><FIRST_NAME>Ann</FIRST_NAME><SECOND_NAME>Roe</SECOND_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME>Annie</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><YEAR>1970</YEAR></INDIVIDUAL_DATE_OF_BIRTH></INDIVIDUAL></INDIVIDUALS></L>")
    (row,) = watchlists.read_un_xml(spark, un).collect()
    assert (row["id"], row["canonical_name"], row["aliases"], row["dob"]) == ("5", "Ann Roe", ["Annie"], "1970")
    person = '<sanctionEntity logicalId="9"><subjectType code="person"/><nameAlias wholeName="Weak" strong="false"/><nameAlias wholeName="Ann Roe" strong="true"/><birthdate birthdate="1970-01-02"/></sanctionEntity>'
    eu = put(tmp_path, "e.xml", f'<export>{person}<sanctionEntity logicalId="10"><subjectType code="enterprise"/><nameAlias wholeName="X" strong="true"/></sanctionEntity></export>')
    (row,) = watchlists.read_eu_xml(spark, eu).collect()
    assert (row["canonical_name"], row["aliases"], row["dob"]) == ("Ann Roe", ["Weak"], "1970-01-02")


def test_first_write_wins(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(5)
    assert sinks.write_once(df, path) == "written" and sinks.write_once(df.repartition(3), path) == "skipped"
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(spark.range(6), path)


def test_packs(spark, tmp_path):
    put(tmp_path, "a.txt", "a")
    put(tmp_path, "b.txt", "b")
    before = spark.createDataFrame(sinks.manifest(spark, str(tmp_path)).collect())
    put(tmp_path, "b.txt", "changed")
    put(tmp_path, "c.txt", "c")
    (tmp_path / "a.txt").unlink()
    assert {r["name"]: r["status"] for r in sinks.verify(before, sinks.manifest(spark, str(tmp_path))).collect()} == {"a.txt": "missing", "b.txt": "changed", "c.txt": "unexpected"}


def test_rows_beyond_the_limit_are_told(spark, tmp_path, monkeypatch):
    """A file of more rows than are read says how many are left out, in its rows and in the log."""
    path = put(tmp_path, "long.csv", "name,city\n" + "".join(f"n{i},c{i}\n" for i in range(files.MAX_ROWS + 3)))
    got = files.ingested(spark, path).where("cells IS NOT NULL")
    assert {r["left_out"]: r["n"] for r in got.groupBy("left_out").agg(F.count(F.lit(1)).alias("n")).collect()} == {3: files.MAX_ROWS}
    with pytest.raises(ValueError, match="3 rows beyond"):
        files.read_table(spark, path)
    assert files.read_table(spark, path, cut=True).count() == files.MAX_ROWS
    files.log_failures(files.ingested(spark, path), str(tmp_path / "log"))
    assert [r["error"] for r in spark.read.json(str(tmp_path / "log")).collect()] == ["rows left out: 3"]


def test_packs_tell_what_was_changed(spark, tmp_path):
    """Many files a batch, an empty batch's absence, a changed file, a lost one, one that nobody listed, and a manifest that was edited."""
    rows = spark.createDataFrame([(f"B{i % 4}", i, f'n "{i}", x\ny') for i in range(400)], "trace_id string, row_index long, original string").repartition(3)
    path = str(tmp_path / "packs")
    sinks.write_packs(rows, rows.where("row_index < 40"), rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")), path, "t", rows=7)
    got = {r["trace_id"]: r for r in sinks.verify_packs(spark, path).collect()}
    assert set(got) == {"B0", "B1", "B2", "B3"} and all(r["valid"] and r["manifest_ok"] and r["files"] > 15 for r in got.values())
    results = sorted((tmp_path / "packs/files/results").glob("trace_id=B0/*.csv"))
    results[0].write_text("other")
    results[1].unlink()
    (tmp_path / "packs/files/audit/trace_id=B1/new.json").write_text("{}")
    for crc in (tmp_path / "packs").rglob(".*.crc"):
        crc.unlink()
    kept = next(p for p in (tmp_path / "packs/manifests").glob("*.json") if '"trace_id":"B2"' in p.read_text())
    kept.write_text(kept.read_text().replace('"generated_at":"t"', '"generated_at":"u"'))
    got = {r["trace_id"]: r for r in sinks.verify_packs(spark, path).collect()}
    assert sorted(w.rsplit(":", 1)[1] for w in got["B0"]["wrong"]) == ["changed", "missing"] and got["B1"]["wrong"] == ["audit/trace_id=B1/new.json:unexpected"]
    assert not any(got[b]["manifest_ok"] for b in ("B2",)) and not any(got[b]["valid"] for b in ("B0", "B1", "B2"))


def test_records_are_scrubbed_however_deep(spark):
    from tallyweave.functions import pii

    rows = spark.createDataFrame([([{"note": "a@b.org", "TOKEN": "x", "n": 3}], {"Secret": [1], "k": [2]}, None)], "l array<struct<note:string,TOKEN:string,n:int>>, m map<string,array<int>>, s struct<phi:int,t:string>").select(F.struct("l", "m", "s").alias("r"))
    got = rows.select(pii.scrub_value(F.col("r"), rows.schema["r"].dataType).alias("r")).collect()[0]["r"]
    assert [tuple(x) for x in got["l"]] == [("[EMAIL_REDACTED]", pii.HIDDEN, 3)] and got["m"] == {"Secret": None, "k": [2]} and got["s"] is None


def test_exports_of_one_task_come_back_whole(spark, tmp_path):
    """More rows in one task than the reader takes from a file."""
    rows = files.MAX_ROWS + 50_000
    sinks.write_csv(spark.range(rows).selectExpr("id AS row_index", "concat('n', id) AS original").coalesce(1), "company", str(tmp_path / "out"))
    back = files.ingested(spark, str(tmp_path / "out")).where("cells IS NOT NULL")
    assert back.agg(F.count(F.lit(1)), F.countDistinct(F.col("cells")[0]), F.max("left_out")).first() == (rows, rows, 0)
