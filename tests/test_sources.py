"""Readers and sinks on small generated files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.gates import GateError, require
from tallyspark.sources import grids, readers, sinks
from tallyspark.streaming import events


def test_csv_is_text_and_strict(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"a ""quoted"", cell"\n2,1958.0\n')
    rows = readers.csv_text(spark, str(tmp_path / "a.csv"), ["k", "v"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'a "quoted", cell'), ("2", "1958.0")]
    assert {tuple(r) for r in readers.recount(spark, str(tmp_path / "a.csv"), 0).collect()} == {("1", 1), ("2", 1)}


def test_json_shard_name_must_match(spark, tmp_path):
    schema = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "2001.json").write_text('{"year": 2001, "n": 5}')
    assert readers.json_shards(spark, str(tmp_path), schema, "year").first()["n"] == 5
    (tmp_path / "2002.json").write_text('{"year": 2003, "n": 6}')
    with pytest.raises(Exception, match="differ"):
        readers.json_shards(spark, str(tmp_path), schema, "year").collect()


def test_xlsx(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    row = readers.xlsx_rows(spark, str(tmp_path / "a.xlsx")).first()
    assert (row["row"], row["cells"]) == (1, {"A": "name", "C": "12.5"})


GRID = [
    (1, {"A": "As of June"}), (3, {"D": "Active  duty", "H": "Reserve"}), (4, {"D": "Army***", "E": "Navy", "F": "Total", "H": "Army"}),
    (5, {"A": "UNITED STATES"}), (6, {"B": "Ohio", "D": "1,200", "E": "3", "F": "1203", "H": "9"}), (7, {"B": "Utah*", "D": "*", "E": "2", "F": "7"}), (8, {"A": "United States Total", "D": "1205", "E": "5", "F": "1210"}),
    (9, {"B": "Peru", "D": "N/A", "E": "4", "F": "4"}), (10, {"A": "OVERSEAS TOTAL", "D": "0", "E": "4", "F": "4"}), (11, {"A": "GRAND TOTAL", "D": "1205", "E": "9", "F": "1214"}), (12, {"A": "Footnote", "D": "77"}),
]
PRINTED = [("us", "UNITED STATES TOTAL"), ("overseas", "OVERSEAS TOTAL")]
FIELDS = {"ARMY": "army", "NAVY": "navy", "TOTAL": "total"}


def read_grid(spark, rows):
    df = spark.createDataFrame([("f", r, {**c, "L": c.get("A") or c.get("B")}) for r, c in rows], "k string, row int, cells map<string,string>")
    return grids.sectioned(df, ["k"], grids.headed_columns(df, ["k"], "ACTIVE DUTY", FIELDS, ["army", "total"]), "L", PRINTED, "GRAND TOTAL")


def test_grids_are_read_by_headings_and_sections(spark):
    cells = read_grid(spark, GRID)
    got = {(r["section"], r["label"], r["field"]): (r["kind"], r["state"], r["n"]) for r in cells.collect()}
    assert got["us", "Ohio", "army"] == ("row", "value", 1200)
    assert got["us", "Utah*", "army"] == ("row", "suppressed", None)
    assert got["overseas", "Peru", "navy"] == ("row", "value", 4)
    assert ("overseas", "Peru", "army") not in got
    assert got[None, "GRAND TOTAL", "total"] == ("grand", "value", 1214)
    assert len(got) == 17
    found = [(r["rule"], r["detail"]) for r in grids.printed_totals(cells, ["k"]).collect()]
    assert [x[0] for x in found] == ["section total"]  # no number at all, and 0 printed
    assert '"field":"army"' in found[0][1]


def test_a_wrong_total_stops_the_run(spark):
    change = lambda row, **c: [(r, cells | c if r == row else cells) for r, cells in GRID]
    gone = lambda row: [(r, cells) for r, cells in GRID if r != row]
    fine = change(9, D="0")
    assert grids.printed_totals(read_grid(spark, fine), ["k"]).count() == 0
    for row, field, value in ((8, "E", "6"), (8, "D", "1199"), (11, "F", "1"), (9, "E", "5")):
        with pytest.raises(GateError, match="total"):
            require(grids.printed_totals(read_grid(spark, [(r, c | {field: value} if r == row else c) for r, c in fine]), ["k"]))
    for rows, message in ((gone(3), "no heading"), (gone(10), "out of order"), (change(4, E="Marines"), "known"), (change(4, E="Army"), "twice"), (change(4, F=""), "missing"), (change(8, A="OVERSEAS TOTAL"), "out of order")):
        with pytest.raises(GateError, match=message):
            read_grid(spark, rows).count()


def test_all_sheets_of_a_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda text: f'<worksheet {space}><sheetData><row r="2"><c r="AB2" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Second" sheetId="1" r:id="r2"/><sheet name="First" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("one"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("two"))
    assert [tuple(r)[1:] for r in readers.xlsx_sheets(spark, str(tmp_path / "b.xlsx")).collect()] == [("Second", 2, {"AB": "two"}), ("First", 2, {"AB": "one"})]
    assert readers.xlsx_rows(spark, str(tmp_path / "b.xlsx")).first()["cells"] == {"AB": "two"}
    assert spark.range(1).select(grids.column_number(F.lit("AB")), grids.column_number(F.lit("Z"))).first()[:] == (28, 26)


def test_zipped_xml(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b1.xml", "<bill><number>7</number><title>An Act</title></bill>")
    rows = readers.xml_rows(readers.zipped_xml(spark, str(tmp_path / "a.zip")), "number int, title string")
    assert tuple(rows.first())[2:] == (7, "An Act")


def test_yaml_records(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- id:\n    code: B000001\n    icpsr: 12\n  terms:\n  - type: rep\n    start: '1999-01-06'\n  - type: sen\n    start: '2001-01-03'\n- id: {}\n".replace("- id: {}\n", ""))
    row = readers.yaml_records(spark, str(tmp_path / "a.yaml"), "id struct<code: string, icpsr: int>, terms array<struct<type: string, start: string>>").first()
    assert row["id"]["icpsr"] == 12
    assert [x["type"] for x in row["terms"]] == ["rep", "sen"]
    (tmp_path / "b.yaml").write_text("HSAG:\n- name: A\n  rank: 1\nHSAP:\n- name: B\n  rank: 2\n")
    assert {(r["_key"], r["name"]) for r in readers.yaml_records(spark, str(tmp_path / "b.yaml"), "name string, rank int").collect()} == {("HSAG", "A"), ("HSAP", "B")}


def test_html_and_text_tables(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>Asset<td>Value</tr><tr><td>Bond</td><td>$1,001 - $15,000</td></tr></table>"), (2, None)], "k int, h string")
    assert [r["cells"] for r in readers.html_tables(pages, "k", "h").collect()][-1] == ["Bond", "$1,001 - $15,000"]
    lines = spark.createDataFrame([("f", 1, "Bosnia and"), ("f", 2, "Herzegovina 1,200 3"), ("f", 3, "Total 5 6")], ["f", "i", "t"])
    got = readers.country_lines(lines, ["f"], "i", "t", 2).orderBy("i").collect()
    assert [(r["name"], r["numbers"], r["is_total"]) for r in got] == [("Bosnia and Herzegovina", [1200, 3], False), ("Total", [5, 6], True)]
    value = spark.createDataFrame([("FY | 2020 | 2021\nRemovals | 1,234 | 99\n",)], ["t"]).select(readers.table_value(F.col("t"), "Removals", 0)).first()[0]
    assert value == 1234.0
    states = spark.createDataFrame([("*",), ("12",), ("N/A",)], ["c"]).select(readers.tri_state(F.col("c")).alias("s")).collect()
    assert [tuple(r["s"]) for r in states] == [("suppressed", None), ("value", 12), (None, None)]
    wiki = spark.createDataFrame([(1, "* [[Roe v. Wade]], 410 U.S. 113 (1973) x\n* other")], ["k", "t"])
    assert tuple(readers.wiki_entries(wiki, "k", "t").first()) == (1, "Roe v. Wade", 410, 113, 1973)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, g string")
    sinks.write_entities(rows, rows.schema, str(tmp_path / "e"))
    with pytest.raises(ValueError, match="expected"):
        sinks.write_entities(rows.drop("g"), rows.schema, str(tmp_path / "f"))
    assert {tuple(r) for r in sinks.write_shards(rows, str(tmp_path / "s"), "g").collect()} == {("a", 2), ("b", 1)}
    coded, table = sinks.with_dictionary(rows, "g")
    assert {tuple(r) for r in table.collect()} == {("a", 0), ("b", 1)}
    packed = sinks.encoded(rows, ["g"], ["n"])
    assert {tuple(r) for r in sinks.decoded(packed, ["g"]).collect()} == {("a", 1), ("a", 2), ("b", 3)}
    assert sinks.checksums(spark, str(tmp_path / "e" / "*.parquet")).count() >= 1
    assert sinks.summary(x=rows, y=rows.limit(1)).first().asDict() == {"x": 3, "y": 1}


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    events.append_new(stream.select("event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()
    assert events.windowed_counts(stream).isStreaming
