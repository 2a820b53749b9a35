import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.operators import geometry, graph, pages, structure
from folio.sources import files


@pytest.mark.parametrize("spec", ["", "0", "3-2", "a", "1,,2", "1-0", "-3"])
def test_malformed_page_lists(spec):
    with pytest.raises(ValueError):
        pages.parse_ranges(spec)


def test_pages_past_the_end_and_nothing_left(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2)], "path string, page_no int")
    with pytest.raises(Exception, match="out of range"):
        pages.extract(p, "1-3").collect()
    with pytest.raises(Exception, match="no page would be left"):
        pages.delete(p, "1-").collect()
    assert [r.page_no for r in pages.extract(p, "2,1,2").orderBy("out_no").collect()] == [2, 1, 2]


def test_insert(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "page_no int, n string")
    q = spark.createDataFrame([(1, "x")], "page_no int, n string")
    assert [r.n for r in pages.insert(p, q, 1).orderBy("out_no").collect()] == ["a", "x", "b"]


def test_edges_compare_with_the_last_kept(spark):
    row = spark.createDataFrame([([0.0, 1.5, 3.0, 4.5, 9.0],)], "v array<double>").select(geometry.cluster_edges(F.col("v")).alias("e")).first()
    assert row.e == [0.0, 3.0, 9.0]


def test_segments_compare_with_the_first_of_a_run(spark):
    s = [(0.0, 0.0, 5.0), (1.5, 4.0, 9.0), (3.0, 8.0, 12.0), (0.0, 20.0, 30.0)]
    row = spark.createDataFrame([(s,)], "v array<struct<at:double,start:double,stop:double>>").select(geometry.merge_segments(F.col("v")).alias("m")).first()
    assert [tuple(x) for x in row.m] == [(0.0, 0.0, 5.0), (0.0, 20.0, 30.0), (3.0, 8.0, 12.0)]


def test_cells_are_half_open(spark):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, (-5.0, 0.0, 9.9, 10.0, 20.0, 30.0)))).alias("v"))
    assert [r[0] for r in rows.select(geometry.cell_of(F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)), F.col("v"))).collect()] == [0, 0, 0, 1, 1, 1]


def test_prose_in_two_columns_is_no_table(spark):
    rows = [(0, n, c, 50.0 + 300 * c, 100.0 + 14 * n, 50.0 + 300 * c + 240, 110.0 + 14 * n, 10.0, "several words of running prose here") for n in range(8) for c in range(2)]
    pieces = spark.createDataFrame(rows, "page int, line int, seq int, l double, t double, r double, b double, size double, text string")
    assert geometry.loose_tables(geometry.fragments(pieces, ["page"]), ["page"]).isEmpty()


def test_folded_cell_belongs_to_the_row_above(spark):
    table = [["Name", "Note", "Sum"], ["a", "long", "1"], ["", "tail", ""], ["b", "x", "2"], ["c", "y", "3"], ["d", "z", "4"]]
    y, rows = 100.0, []
    for n, line in enumerate(table):
        y += 12.0 if line[0] == "" else 24.0
        rows += [(0, n, c, 50.0 + 100 * c, y, 50.0 + 100 * c + 6 * len(t), y + 10, 10.0, t) for c, t in enumerate(line) if t]
    pieces = spark.createDataFrame(rows, "page int, line int, seq int, l double, t double, r double, b double, size double, text string")
    frags = geometry.fragments(pieces, ["page"])
    grids = geometry.loose_tables(frags, ["page"])
    assert [(g.rows, g.cols) for g in grids.collect()] == [(5, 3)]
    cells = {(r.r, r.c): r.text for r in geometry.cells(frags, grids, ["page"]).collect()}
    assert cells[1, 1] == "long tail" and cells[4, 2] == "4"


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.root for r in graph.components(edges).where("node < 100").collect()} == {0}


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "src string, dst string")
    assert sorted(r.node for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()) == ["a", "b"]


def test_reachability_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as src", "id + 1 as dst").coalesce(1)
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).count() == 301


def test_bookmarks_never_jump(spark):
    heads = spark.createDataFrame([(0, k, level, f"t{k}") for k, level in enumerate((3, 1, 3, 3, 2, 4))], "file int, seq0 int, level int, text string")
    assert [r.depth for r in structure.bookmarks(heads, "file", "seq0").orderBy("seq").collect()] == [0, 0, 1, 2, 1]


def test_bookmark_text_round_trip(spark):
    rows = spark.createDataFrame([("f", 1, 0, "One", 1), ("f", 2, 1, "Two words", 2)], "file string, seq int, depth int, title string, page int")
    text = structure.bookmark_export(rows, "file")
    back = structure.bookmark_import(text, "file", "export").orderBy("seq").collect()
    assert [(r.depth, r.title, r.page) for r in back] == [(0, "One", 1), (1, "Two words", 2)]


def test_workbook(spark):
    from folio.functions.values import detect

    cells = spark.createDataFrame([("a", 1, 0, 0, "Sum"), ("a", 1, 0, 1, "1,234.50"), ("a", 2, 1, 0, "x")], "path string, table_no int, r int, c int, text string").withColumn("value", detect(F.col("text")))
    book = files.workbooks(cells).first()
    z = zipfile.ZipFile(io.BytesIO(book.content))
    assert z.testzip() is None and b"<v>1234.5</v>" in z.read("xl/worksheets/sheet1.xml") and b"#,##0.00" in z.read("xl/styles.xml")


def test_rules(spark):
    s = spark.createDataFrame([(0.0, 0.0, 0.2, 50.0, False), (0.0, 0.0, 50.0, 50.0, False), (0.0, 10.0, 80.0, 12.0, True), (0.0, 0.0, 9.0, 9.0, True)], "x0 double, y0 double, x1 double, y1 double, filled boolean")
    assert sorted((r.l, r.t, r.r, r.b) for r in geometry.rule_lines(s).collect()) == [(0.0, 11.0, 80.0, 11.0), (0.1, 0.0, 0.1, 50.0)]


def test_redaction_fills_places_in_the_text_itself(spark):
    from folio.operators import redact

    rows = spark.createDataFrame([(1, "The quick\n  brown fox; 6222 0200 1234 5678 901."), (2, None), (3, "")], "id int, text string")
    out = {r.id: (r.text, r.redacted) for r in redact.redact(rows, "text", ["QUICK brown"], ["bank-card"]).collect()}
    assert out == {1: ("The " + "█" * 13 + " fox; " + "█" * 23 + ".", 2), 2: (None, 0), 3: ("", 0)}
    assert [r.id for r in redact.residue(rows, "text", ["FOX", "x"]).collect()] == [1]
    assert redact.spans("aaaa aa", ["aa", "aaa"], []) == [(0, 4), (5, 7)]


def test_a_frame_round_the_page_is_no_table():
    import numpy as np

    from folio.operators import ruled

    def grid(x0, x1, y0, y1, n):
        xs, ys = np.linspace(x0, x1, n), np.linspace(y0, y1, n)
        return np.array([[x0, y, x1, y] for y in ys] + [[x, y0, x, y1] for x in xs])

    assert ruled.grids(grid(0, 100, 0, 100, 3), 100, 100) == []
    two = ruled.grids(np.concatenate([grid(50, 90, 60, 90, 4), grid(0, 40, 5, 40, 3)]), 100, 100)
    assert [len(g["xs"]) for g in two] == [3, 4] and two[0]["owner"].tolist() == [0, 1, 2, 3]


def test_word_files(spark):
    import xml.dom.minidom

    from folio.sources import word

    rows = [("a", 0, "heading", "Title <1>", 1, None), ("a", 1, "para", "text & more", None, None), ("a", 2, "number", "one", None, None), ("a", 3, "number", "two", None, None), ("a", 4, "table", None, None, [["x", "y"], ["z"]]), ("a", 5, "bullet", "dot", None, None)]
    out = word.documents(spark.createDataFrame(rows, "path string, block_no int, kind string, text string, level int, cells array<array<string>>")).first()
    z = zipfile.ZipFile(io.BytesIO(out.content))
    for name in z.namelist():
        xml.dom.minidom.parseString(z.read(name))
    body = z.read("word/document.xml").decode()
    assert "Title &lt;1&gt;" in body and body.count("<w:tc>") == 4 and body.count('<w:numId w:val="2"/>') == 2
