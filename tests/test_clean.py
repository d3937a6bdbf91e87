from __future__ import annotations

import pytest
from visitlog import AS_OF, values, visits

from fleetkpi.operators import clean
from fleetkpi.sources import shape
from fleetkpi.sources.readers import read_visits


def test_cleaning_rules(spark):
    log = visits(
        spark,
        [
            (1, " vd-co01 ", "2024-01-01 08:00:00", "2024-01-01 09:00:00"),
            (2, "VD-CO01", "2024-01-02 08:00:00", "2024-01-01 09:00:00"),  # leaves before entry
            (3, "VD-CO01", "2025-06-01 00:00:00"),  # in the future
            (4, "", "2024-01-03 00:00:00"),
            (5, " nan ", "2024-01-03 00:00:00"),
            (6, None, "2024-01-03 00:00:00"),
            (7, "VD-CO02", None),
            (8, "VD-CO02", "2019-12-31 23:59:59"),  # too early
            (9, "VD-CO02", "2020-01-01 00:00:00", "2020-01-01 00:00:00"),
        ],
    )
    kept = clean.clean_visits(log, "2020-01-01", AS_OF)
    assert values(kept, "visit_id", "codigo") == {1: "VD-CO01", 9: "VD-CO02"}


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([(1, "2024-02-30"), (2, "2024-02-29 10:00:00"), (3, "x"), (4, None)], "i int, t string")
    parsed = clean.parse_dates(df, "t")
    assert [r.i for r in parsed.filter("t is not null").collect()] == [2]


def test_defaults_for_absent_columns(spark):
    df = spark.createDataFrame([(1, None), (2, " motor ")], "i int, sistema_afectado string")
    row = values(clean.fill_defaults(df), "i", "sistema_afectado", "flota", "clase")
    assert row == {
        1: ("NO_ESPECIFICADO", "GENERAL", "EQUIPO_GENERAL"),
        2: ("MOTOR", "GENERAL", "EQUIPO_GENERAL"),
    }


def test_range_check_drops_missing_measures(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, 730.0, 720.0), (3, 731.0, 1.0), (4, None, 1.0), (5, 1.0, None), (6, 1.0, -1.0)],
        "i int, tbf_dias double, mttr_horas double",
    )
    assert sorted(r.i for r in clean.validate_ranges(df).collect()) == [1, 2]


def test_month_slice_is_half_open(spark):
    log = visits(spark, [(1, "A-1", "2024-02-01 00:00:00"), (2, "A-1", "2024-02-29 23:59:59"), (3, "A-1", "2024-03-01 00:00:00")])
    assert sorted(r.visit_id for r in clean.slice_month(log, "2024-02").collect()) == [1, 2]


def test_requested_month_wins_over_the_last(spark):
    log = visits(spark, [(1, "A-1", "2024-02-01 00:00:00"), (2, "A-1", "2024-03-05 00:00:00")])
    assert [r.visit_id for r in clean.latest_month_if_empty(log, "2024-02").collect()] == [1]
    assert [r.visit_id for r in clean.latest_month_if_empty(log, "2023-01").collect()] == [2]


def test_column_names():
    assert shape.clean_names(["FECHA IN", "Fecha-In", "%%", "__Año 1__", "fecha_in"]) == [
        "fecha_in",
        "fecha_in_1",
        "unnamed_col",
        "año_1",
        "fecha_in_2",
    ]


def test_alias_never_replaces_a_present_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "CODIGO int, EQUIPO int, INGRESO int")
    assert shape.map_columns(df).columns == ["CODIGO", "EQUIPO", "FECHA_IN"]


def test_code_column_by_values(spark):
    found = spark.createDataFrame([("VD-01",), (None,)], "clave string")
    short = spark.createDataFrame([("V-1",), ("abc",)], "clave string")
    assert shape.detect_code_column(found) == "clave"
    assert shape.detect_code_column(short) is None


def test_csv_with_banner_lines(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "sheet.csv").write_text(
        "Registro de taller,,\n,,\nCODIGO,FECHA IN,SISTEMA AFECTADO\n"
        "vd-01,2024-01-05 10:00:00,motor\n,,\nvd-02,sin fecha,frenos\n"
    )
    log = read_visits(spark, str(folder), "csv")
    assert log.columns == ["codigo", "fecha_in", "sistema_afectado"]
    rows = clean.clean_visits(log, "2020-01-01", AS_OF).collect()
    assert [(r.codigo, r.sistema_afectado) for r in rows] == [("VD-01", "MOTOR")]


def test_csv_files_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "my log"
    folder.mkdir()
    (folder / "a.csv").write_text("CODIGO,FECHA IN,SISTEMA AFECTADO\nvd-01,2024-01-05 10:00:00,motor\n")
    (folder / "b.csv").write_text("Hoja 2,,,\n\"Fecha In\",CODIGO,horas,Taller\n05/02/2024 08:00,vd-02,7,norte\n")
    (folder / "c.csv").write_text("CODIGO,FECHA IN,SISTEMA AFECTADO\nvd-03,2024-03-05 10:00:00,frenos\n")
    (folder / "d.csv").write_text("")
    log = read_visits(spark, str(folder), "csv").where("codigo like 'vd%'")
    assert {"codigo", "fecha_in", "sistema_afectado", "taller"} <= set(log.columns)
    assert {tuple(x) for x in log.select("codigo", "fecha_in", "sistema_afectado", "taller").collect()} == {
        ("vd-01", "2024-01-05 10:00:00", "motor", None),
        ("vd-02", "05/02/2024 08:00", None, "norte"),
        ("vd-03", "2024-03-05 10:00:00", "frenos", None),
    }
    dates = clean.parse_dates(log, "fecha_in").selectExpr("codigo", "cast(fecha_in as date) as d")
    assert values(dates, "codigo", "d")["vd-02"].isoformat() == "2024-02-05"


def test_date_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "visits")
    visits(spark, [(1, "A-1", "2024-02-01 00:00:00")]).write.parquet(path)
    log = clean.clean_visits(read_visits(spark, path), "2020-01-01", AS_OF)
    plan = clean.slice_month(log, "2024-02").select("codigo")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(fecha_in" in plan
    assert "ReadSchema: struct<codigo:string,fecha_in:timestamp,fecha_out:timestamp>" in plan


@pytest.mark.parametrize("limit", [1, None])
def test_valid_codes(spark, limit):
    df = spark.createDataFrame([("VD-01",), ("VD-01",), ("V-1",), ("CG-02",), ("abcde",)], "codigo string")
    codes = [r.codigo for r in clean.valid_codes(df, limit).collect()]
    assert codes == ["CG-02", "VD-01"][:limit]


@pytest.mark.parametrize(
    "text",
    ["2024-03-15", "15/03/2024", "03/15/2024", "15-03-2024 10:30", "Mar 15 2024", "2024/03/15", "15.3.2024 10:30:05", "20240315"],
)
def test_usual_date_formats(spark, text):
    day = clean.parse_dates(spark.createDataFrame([(text,)], "d string"), "d").first().d
    assert (day.year, day.month, day.day) == (2024, 3, 15)


def test_day_or_month_first(spark):
    df = spark.createDataFrame([("03/04/2024",)], "d string")
    assert clean.parse_dates(df, "d").first().d.month == 4
    assert clean.parse_dates(df, "d", day_first=False).first().d.month == 3
    assert clean.parse_dates(df, "d", formats=["yyyy"]).first().d is None
