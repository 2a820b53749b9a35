"""Queries on small tables made to hold what only larger or odder ones do, against their SQL."""

import duckdb
import pytest

from folio.plans import queries


@pytest.fixture
def agree(spark, tmp_path):
    """The rows of a query over tables given as SQL of DuckDB, once Spark and its SQL agree on them."""

    def run(name, **tables):
        c = duckdb.connect()
        c.sql("set timezone = 'UTC'")
        for table, sql in tables.items():
            c.sql(f"copy ({sql}) to '{tmp_path}/{table}.parquet'")
            c.sql(f"create view {table} as from '{tmp_path}/{table}.parquet'")
        df = queries.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        mine = sorted(map(tuple, df.select(*columns).collect()))
        assert mine == sorted(c.sql(queries.ORACLES[name]).select(*[f'"{x}"' for x in columns]).fetchall())
        return [dict(zip(columns, r, strict=True)) for r in mine]

    return run


def test_sums_are_rounded_to_whole_numbers(agree):
    """4151.53 * 1000 is a little less than 4151530; halves go to the even number."""
    sums = [4151.53, -261.28, 8324.89, 0.0005, 0.0015, 0.0025, -0.0015, 12.0]
    rows = " union all ".join(f"select {k}::bigint c_custkey, 'C{k}' c_name, 'M' c_mktsegment, {v}::double c_acctbal" for k, v in enumerate(sums))
    found = {r["c_custkey"]: r["grouped"] for r in agree("safe_texts", customer=rows)}
    assert (found[0], found[1]) == ("4,151,530", "-261,280")


def test_lines_with_long_runs_gone_stay_whole(agree, spark):
    """Five signs gone in a row, and 39 of them: a line is one rectangle, two lines are two. The operator itself parts a line
    at a gap of three heights."""
    from folio.operators import layout

    keys = [*range(4, 14), *(17 * k + 3 for k in range(1, 6)), *range(105, 130), *(17 * k + 3 for k in range(8, 47)), *range(800, 830)]
    found = agree("selection_rects", orders=f"select unnest({keys})::bigint o_orderkey, 5::bigint o_custkey, 1.0 o_totalprice")
    assert [(r["rect_no"], r["l"], r["r"], r["t"]) for r in found] == [(1, 0.0, 240.0, 0.0), (2, 234.0, 240.0, 20.0), (3, 0.0, 174.0, 40.0)]
    chars = spark.createDataFrame([(0, k, x, 0.0, x + 6, 10.0) for k, x in enumerate((0.0, 35.9, 72.0))], "f int, i int, l double, t double, r double, b double")
    assert layout.selection_rects(chars, ["f"], "i").count() == 2


def test_a_page_list_is_never_laid_out_to_be_joined(spark):
    """An open range names every page of every file: as many rows as there are pages, which may not go to one place."""
    from pyspark.sql import functions as F

    from folio.operators import pages

    p = spark.range(30000).select((F.col("id") % 3).alias("path"), F.floor(F.col("id") / 3 + 1).cast("int").alias("page_no"), "id")
    out = pages.extract(p, "2-3,1,1,2-")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # the list's entries are told behind the join, of each page alone
    rows = {(r.path, r.out_no): r.page_no for r in out.collect()}
    assert len(rows) == 30009 and [rows[2, k] for k in range(1, 7)] == [2, 3, 1, 1, 2, 3] and rows[1, 10003] == 10000
    gaps = spark.createDataFrame([(0, 1, "a"), (0, 4, "b"), (0, 4, "c"), (None, 9, "d")], "path int, page_no int, n string")
    assert sorted((r.out_no, r.n) for r in pages.extract(gaps, "4,1-2,3-").collect()) == [(1, "b"), (1, "c"), (2, "a"), (5, "b"), (5, "c")]


def test_a_merged_file_is_made_one_source_at_a_time(spark):
    """Files of a group in order, a broken one an error row of its group; no array of all its files, and the same told by `want`."""
    from pyspark.sql import functions as F

    from folio.sources import files, rewrite
    from folio.sources.pdf import writer

    rows = [(k % 3 if k % 4 else None, k, writer.text_file([[f"text {k}"]] * (k % 2 + 1))) for k in reversed(range(60))] + [(7, 1, b"none"), (7, 2, writer.text_file([["x"]]))]
    source = spark.createDataFrame(rows, "g int, k int, content binary")
    merged = rewrite.merge(source, "g", F.col("k"))
    assert "collect_list" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert {r.g: r.status for r in merged.collect()} == {0: "ok", 1: "ok", 2: "ok", None: "ok", 7: "error"}
    lines = files.read(merged.where("status = 'ok'").select(F.coalesce(F.col("g").cast("string"), F.lit("none")).alias("path"), "content"), "lines")
    found = [r.line.strip() for r in lines.where("path = '1'").orderBy("page_no", "line_no").collect()]
    assert found == [f"text {k}" for k in range(60) if k % 3 == 1 and k % 4 for _ in range(k % 2 + 1)]
    info = {r.g: (r.pages, r.repaired, r.status) for r in rewrite.merge(source, "g", F.col("k"), "info").collect()}
    assert info[1] == (len(found), False, "ok") and info[None] == (15, False, "ok") and info[7][2] == "error" and len(info) == 5
