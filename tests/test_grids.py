"""Cells of tables in zipped XML."""

import io
import zipfile

from tessera.sources import grids


def archive(**sections):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, xml in sections.items():
            z.writestr(f"Contents/{name}.xml", xml)
    return f.getvalue()


def tc(*paras, rows=1, cols=1, extra=""):
    return f'<hp:tc><hp:subList>{"".join(f"<hp:p><hp:run><hp:t>{p}</hp:t></hp:run></hp:p>" for p in paras)}{extra}</hp:subList><hp:cellSpan colSpan="{cols}" rowSpan="{rows}"/></hp:tc>'


def tbl(*rows):
    return f'<hp:p><hp:run><hp:t>before</hp:t><hp:tbl>{"".join(f"<hp:tr>{r}</hp:tr>" for r in rows)}</hp:tbl><hp:t>after</hp:t></hp:run></hp:p>'


def test_spans_lines_and_nested_tables():
    inner = tbl(tc("inner"))
    xml = "<?xml version='1.0' encoding='UTF-8'?><hs:sec xmlns:hp='x' xmlns:hs='y'>" + tbl(tc("a", rows=2) + tc("b &amp; c", "second", cols=2), tc("d") + tc("e", extra=inner), tc("f")) + "</hs:sec>"
    got = grids.read_cells(archive(section0=xml, section10=tbl(tc("last")), section2=tbl(tc("middle"))))
    assert got == [
        (0, 0, 0, 0, 0, 2, 1, "a"),
        (0, 0, 0, 1, 1, 1, 2, "b & c\nsecond"),
        (0, 0, 1, 0, 1, 1, 1, "d"),
        (0, 1, 0, 0, 0, 1, 1, "inner"),
        (0, 0, 1, 1, 2, 1, 1, "e\nbeforeafter"),
        (0, 0, 2, 0, 0, 1, 1, "f"),
        (2, 2, 0, 0, 0, 1, 1, "middle"),
        (10, 3, 0, 0, 0, 1, 1, "last"),
    ]


def test_broken_files(spark):
    whole = tbl(tc("kept") + tc("too"))
    broken = archive(section0=whole + "<hp:p><hp:tbl><hp:tr><hp:tc><hp:p><hp:t>lost")
    assert [r[7] for r in grids.read_cells(broken)] == ["kept", "too"]
    assert grids.read_cells(b"no archive") == [] and grids.read_cells(None) == [] and grids.read_cells(archive(other="x")) == []
    df = spark.createDataFrame([("a", broken), ("b", None), ("c", b"no")], "path string, content binary")
    assert sorted((r.path, r.text) for r in grids.table_cells(df).collect()) == [("a", "kept"), ("a", "too")]
    grids.register(spark)
    df.createOrReplaceTempView("zipped_files")
    assert spark.sql("SELECT path, text FROM zipped_files, LATERAL table_cells(content) WHERE nth = 1").collect()[0].text == "too"


def test_start_pages(spark):
    rows = tbl(tc("1. First  rule") + tc(" 12 "), tc("2. Second") + tc("x"), tc("Second") + tc("9"), tc("3. First rule") + tc("99"), tc("4. Third\nrule") + tc("30") + tc("z"))
    df = spark.createDataFrame([("a", archive(section0=rows))], "path string, content binary")
    names = spark.createDataFrame([("First rule",), ("Second",), ("Third rule",), ("Fourth",)], "name string")
    assert sorted(map(tuple, grids.start_pages(grids.table_cells(df), names).collect())) == [("First rule", 12), ("Third rule", 30)]


def test_cells_leave_a_file_as_they_are_read(spark, monkeypatch):
    rows = 3000
    cells = grids.iter_cells(archive(section0=tbl(*(tc(f"cell {i}" + "x" * 100) for i in range(rows)))))
    assert next(cells)[-1].startswith("cell 0x") and cells.gi_frame is not None
    monkeypatch.setattr(grids, "CELLS", 100)
    files = spark.createDataFrame([("a", archive(section0=tbl(*(tc(i) for i in range(250))))), ("b", b"none"), ("c", None)], "path string, content binary")
    assert sorted((r.path, r.row, r.text) for r in grids.table_cells(files).collect()) == sorted(("a", i, str(i)) for i in range(250))
