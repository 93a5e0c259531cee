import datetime as dt
from itertools import product

import pytest
from pyspark.sql import functions as F

from tablescope.functions import cells
from tablescope.operators import clean as C
from tablescope.operators.infer import infer_types
from tablescope.sources import readers, sinks


def one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.select(fn(F.col("c")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_parse_number(spark):
    raw = ["$1,200.50", "45%", "(450)", "12,500 ₪", "1.234,56", "12,5", "1.234.567", "hello", "", None, "1.234", "1,234", "-5.3",
           "1,234,567.89", "1.234.567,8", "USD 99", "(1,200)", "12,56"]
    want = [1200.5, 45.0, -450.0, 12500.0, 1234.56, 12.5, 1234567.0, None, None, None, 1.234, 1234.0, -5.3,
            1234567.89, 1234567.8, 99.0, -1200.0, 12.56]
    assert one(spark, raw, cells.parse_number) == want


def test_parse_number_by_its_patterns(spark):
    """Cells without a comma pass fewer patterns than others: all short cells against the patterns passed by every cell, and the steps of one."""
    def by_patterns(c):
        core = F.regexp_replace(c, r"[^0-9.,\-]", "")
        marked = F.regexp_replace(core, cells._DECIMAL_COMMA, "$1$2;")
        plain = F.when(core.rlike(r"^[^,]*\.[^,]*\.[^,]*$"), F.replace(core, F.lit("."))).otherwise(F.translate(F.regexp_replace(marked, r"\.(?=.*;)", ""), ";,", "."))
        sign = F.when(c.rlike(r"^\s*\([^-]*\)\s*$"), F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.regexp_extract(plain, r"-?[0-9]+(\.[0-9]+)?", 0).try_cast("double") * sign + F.lit(0.0)

    raw = [None, *("".join(x) for n in range(6) for x in product("12.,-", repeat=n)), *("".join(x) for n in range(5) for x in product("1.,(- )\nx", repeat=n))]
    assert one(spark, raw, cells.parse_number) == one(spark, raw, by_patterns)
    steps = spark.createDataFrame([("x",)], "c string").select(cells.parse_number(F.col("c")))._jdf.queryExecution().analyzed().toString()
    assert "Contains" in steps or "contains" in steps


def test_canonical_date(spark):
    raw = ["1/1/2023", "2023-1-5", "2023-01-05 9:07", "13/06/2026", "06/13/2026", "5 Mar 2024", "March 5, 2024", "Mar 5 2024", "x", "13/13/2020",
           "2023-02-30", "1.2.24", "2023-01-05T10:20:30Z"]
    want = ["2023-01-01", "2023-01-05", "2023-01-05 09:07", "2026-06-13", "2026-06-13", "2024-03-05", "2024-03-05", "2024-03-05", None, None,
            None, "2024-01-02", "2023-01-05 10:20"]
    assert one(spark, raw, cells.canonical_date) == want
    assert one(spark, ["03/04/2024"], lambda c: cells.canonical_date(c, True)) == ["2024-04-03"]


def test_missing_markers_depend_on_type(spark):
    raw = ["N/A", "-", " null ", "x", "none", ""]
    assert one(spark, raw, lambda c: cells.is_missing(c, False)) == [True, False, True, False, False, True]
    assert one(spark, raw, lambda c: cells.is_missing(c, True)) == [True, True, True, False, True, True]


def test_spreadsheet_guard(spark):
    raw = ["=SUM(A1)", "+1+1", "-5.3", "+10", "@x", "\tcmd", "plain", None, "שלום"]
    got = one(spark, raw, cells.spreadsheet_safe)
    assert got[:8] == ["'=SUM(A1)", "'+1+1", "-5.3", "+10", "'@x", "'\tcmd", "plain", None]
    assert got[8] == "‎שלום"


MESSY = [("1/1/2023", " North ", "$1,000", "10"), ("1/1/2023", "North", "$1,000", "10"), ("2/1/2023", "South", "$2,500", "20"),
         (None, "", None, " "), ("", "Total", "$3,500", "30")]


def test_clean_small_table(spark):
    df = spark.createDataFrame(MESSY, "Date string, Region string, Revenue string, Units string")
    done = C.clean(df)
    assert done.types == {"Date": "date", "Region": "text", "Revenue": "currency", "Units": "integer"} or done.types["Revenue"] == "currency"
    rows = sorted(tuple(r) for r in done.df.collect())
    assert rows == [(dt.datetime(2023, 1, 1), "North", 1000.0, 10), (dt.datetime(2023, 2, 1), "South", 2500.0, 20)]
    rep = {(r["scope"], r["metric"]): r["n"] for r in done.report.collect()}
    assert [rep["table", m] for m in ("rows_before", "rows_after", "duplicates", "empty_rows", "total_rows")] == [5, 2, 1, 1, 1]


def test_report_reads_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(i: int) -> str:
        seen.add(1)
        return f" {i % 4}"
    raw = spark.range(60).select(F.udf(read)("id").alias("a"), F.when(F.col("id") % 3 == 0, "").otherwise("x").alias("b"))
    types = {"a": "integer", "b": "text"}
    rep = {(r["scope"], r["metric"]): r["n"] for r in C.report(C.side_by_side(raw, types, {}), types).collect()}
    assert rep == {("table", "rows_before"): 60, ("table", "empty_rows"): 0, ("table", "total_rows"): 0, ("table", "rows_after"): 8, ("table", "duplicates"): 52,
                   ("table", "cells_normalized"): 0, ("table", "cells_trimmed"): 60, ("a", "missing"): 0, ("a", "normalized"): 0, ("a", "trimmed"): 60,
                   ("b", "missing"): 20, ("b", "normalized"): 0, ("b", "trimmed"): 0}
    assert seen.value == 60
    none = {(r["scope"], r["metric"]): r["n"] for r in C.report(C.side_by_side(raw.limit(0), types, {}), types).collect()}
    assert none == {("table", m): 0 for m in ("rows_before", "empty_rows", "total_rows", "rows_after", "duplicates")} | {("table", m): None for m in ("cells_normalized", "cells_trimmed")}


def test_day_first_needs_evidence(spark):
    df = spark.createDataFrame([(1, "03/04/2024", "01/02/2024"), (2, "25/04/2024", "02/03/2024"), (3, "04/26/2024", "x")], "i int, a string, b string")
    assert C.day_first_columns(df, ["a", "b"], "i") == {"a": True, "b": False}


def test_type_pins_win(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "v string")
    assert C.clean(df, {"v": "text"}).df.schema["v"].dataType.simpleString() == "string"


def test_infer_types(spark):
    rows = [(f"{i}%", f"${i}.50", "yes" if i % 2 else "no", f"u{i}@x.org", "A" if i % 3 else "B", f"{1000 + i}") for i in range(40)]
    df = spark.createDataFrame(rows, "rate string, paid string, flag string, email string, grade string, order_id string")
    assert infer_types(df) == {"rate": "percent", "paid": "currency", "flag": "boolean", "email": "id", "grade": "category", "order_id": "id"}


def test_normalize_raw_european(spark):
    df = spark.createDataFrame([("1.234,56", "N/A"), ("2.500,00", "a"), ("12,5", " b ")], "amount string, cat string")
    assert [tuple(r) for r in C.normalize_raw(df).collect()] == [(1234.56, None), (2500.0, "a"), (12.5, "b")]


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert C.drop_empty_columns(df).columns == ["a"]


def test_readers_and_csv_sink(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('Region ,Value\nNorth,"1,5"\n,\n" a ""b""",=1+1\n')
    df = readers.read_delimited(spark, str(src), multi_line=True)
    assert df.columns == ["Region", "Value"] and df.count() == 2
    out = str(tmp_path / "out")
    sinks.write_csv(df.coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "'=1+1" in text and '"1,5"' in text
    wrapped = tmp_path / "w.json"
    wrapped.write_text('{"rows": [{"a": 1, "b": {"c": 2}}, {"a": 3}]}')
    got = [tuple(r) for r in readers.read_json(spark, str(wrapped), multi_line=True).orderBy("a").collect()]
    assert got == [(1, '{"c":2}'), (3, None)]
    lines = tmp_path / "l.json"
    lines.write_text('[{"a": 1, "tags": [1, 2]}, {"a": 2, "tags": []}]')
    assert [tuple(r) for r in readers.read_json(spark, str(lines)).orderBy("a").collect()] == [(1, "[1,2]"), (2, "[]")]


def test_choose_source(spark):
    rows = readers.choose_source({"a": spark.range(3), "b": spark.range(9)}).where("chosen").collect()
    assert [r["name"] for r in rows] == ["b"]


def test_write_members(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "segment string, v int")
    sinks.write_members(df, str(tmp_path / "m"), "segment")
    assert spark.read.parquet(str(tmp_path / "m")).where("segment = 'y'").first()["v"] == 2


@pytest.mark.parametrize("op,value,want", [("eq", 3, 1), ("gt", 3, 6), ("lte", 3, 4), ("between", 2, 8)])
def test_conditions(spark, op, value, want):
    from tablescope.operators.relational import where
    assert where(spark.range(10), "id", op, value, 100).count() == want


def test_unknown_column_is_refused(spark):
    from tablescope.operators.relational import where
    with pytest.raises(ValueError):
        where(spark.range(3), "nope", "eq", 1)
