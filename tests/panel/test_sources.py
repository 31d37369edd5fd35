import datetime

import pytest

from lacuna.plans import focused
from lacuna.sources import tables


@pytest.fixture()
def files(tmp_path):
    days = [datetime.date(1980, 1, 1) + datetime.timedelta(k) for k in range(200)]
    lines = ["date,Parm anpur,St'ation B,Only Here,month_sin"] + [f"{d:%d-%m-%Y},{k % 30},{'junk' if k % 5 == 0 else k % 7},1,{k / 10}" for k, d in enumerate(days)]
    (tmp_path / "panel.csv").write_text("\n".join(lines))
    (tmp_path / "places.csv").write_bytes(("﻿Latitude (N),Longitude (E),Name of site\r\n21°50'02\",81°36'21\",Paramanpur\r\n20 30,80.5,station b\r\n1,1,elsewhere").encode())
    (tmp_path / "matrix.csv").write_text(",Latitude (N),Longitude (E),Name of site,V1,V2,V3\r\nV1,1,1,Parmanpur,1,1,1\r\nV2,1,1,Station B,0,0,0\r\nV3,1,1,Elsewhere,0,1,0\r\n")
    return tmp_path


def test_load(spark, files):
    got = tables.load(spark, f"{files}/panel.csv", f"{files}/places.csv", f"{files}/matrix.csv")
    assert {r["station"] for r in got.panel.select("station").distinct().collect()} == {"paramanpur", "stationb"}
    assert got.panel.count() == 400 and got.panel.where("value IS NULL").count() == 40
    assert got.panel.agg({"date": "max"}).first()[0] == datetime.date(1980, 7, 18)
    assert {(r["station"], r["contributor"]) for r in got.edges.collect()} == {("paramanpur", "paramanpur"), ("paramanpur", "stationb")}
    places = {r["station"]: (r["latitude"], r["longitude"]) for r in got.stations.collect()}
    assert places["stationb"] == (20.5, 80.5) and places["paramanpur"][0] == pytest.approx(21 + 50 / 60 + 2 / 3600)
    assert got.calendar.columns == ["date", "month_sin"] and got.codes.count() == 0
    assert tables.load(spark, f"{files}/panel.csv", f"{files}/places.csv", f"{files}/absent.csv").edges is None


def test_iso_dates_and_errors(spark, files):
    (files / "iso.csv").write_text("d,a\n1980-02-01,1\n03/02/1980,2\nnever,3\n")
    wide, stations, _ = tables.read_wide(spark, f"{files}/iso.csv")
    assert stations == ["a"] and [r["date"] for r in wide.orderBy("date").collect()] == [datetime.date(1980, 2, 1), datetime.date(1980, 2, 3)]
    (files / "twice.csv").write_text("d,a b,ab\n1980-02-01,1,2\n")
    with pytest.raises(tables.SourceError, match="one name"):
        tables.read_wide(spark, f"{files}/twice.csv")
    with pytest.raises(tables.SourceError):
        tables.read_wide(spark, f"{files}/absent.csv")
    with pytest.raises(tables.SourceError, match="station"):
        (files / "bad.csv").write_text("Latitude,Longitude\n1,2\n")
        tables.read_coordinates(spark, f"{files}/bad.csv")


def test_focused_fill_and_evaluation(spark, files):
    small = {"n_estimators": 3, "max_iter": 1, "max_depth": 3, "max_bins": 16}
    focused.fill_focused(spark, f"{files}/panel.csv", f"{files}/places.csv", f"{files}/matrix.csv", f"file://{files}/out", "1980-01-01", "1980-07-18", 100, **small)
    back = spark.read.option("header", True).csv(f"file://{files}/out/imputed_1980-01-01_to_1980-07-18.csv")
    assert back.count() == 200 and {"paramanpur", "stationb", "day_of_year_sin", "month_sin"} <= set(back.columns)
    assert back.where("paramanpur IS NULL OR stationb IS NULL").count() == 0
    assert tables.stamped("x", datetime.datetime(2000, 1, 2, 3, 4, 5)) == "x_20000102_030405"


def test_summary(spark):
    rows = spark.createDataFrame([("b", "m", 1.23456789), ("a", "m", None)], "gap_scenario string, method string, rmse double")
    assert [tuple(r) for r in tables.summary(rows).collect()] == [("a", "m", None), ("b", "m", 1.2346)]


def test_plots_have_all_points(spark, tmp_path):
    from lacuna.sources import tables

    cells = spark.range(3000).selectExpr("concat('s', id % 4) AS station", "DATE '2000-01-01' + cast(id AS int) AS date", "id * 1D AS true_value", "id % 3 = 0 AS is_gap", "id + 1D AS filled")
    assert tables.grid(tables.scatter_data(cells), 50).selectExpr("sum(n)").first()[0] == 3000
    tables.write_plots(cells, f"file://{tmp_path}", "any method", 7)
    out = tables.plot_folder(f"file://{tmp_path}", "any method", 7)
    assert spark.read.option("header", True).csv(f"{out}/scatter.csv").count() == 3000
    assert spark.read.option("header", True).csv(f"{out}/series.csv").count() == 2250


def test_repeated_stations_keep_the_first(spark):
    from lacuna.operators import spatial

    rows = spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.0, 5.0), ("a", None, 0.0), ("b", None, 3.0)], "station string, latitude double, longitude double")
    assert sorted(map(tuple, spatial.first_of_each(rows, "station", "latitude", "longitude").collect())) == [("a", 1.0, 5.0), ("b", None, 3.0)]


def test_rejected_texts_are_counted_and_shown(spark, files):
    (files / "odd.csv").write_text("date,Parm anpur,station b,day_of_year_sin\n1980-01-01,1,x,9\nnever,2,3,9\n,4,nan,9\n1980-01-02,,5y,9\n1980-01-03, 7 ,-,q\n")
    (files / "odd_places.csv").write_text("Latitude,Longitude,Station\n20.5,80,paramanpur\n95,80,station b\n1,east,elsewhere\n")
    found = {tuple(r)[1:] for r in tables.rejects(spark, f"{files}/odd.csv", f"{files}/odd_places.csv").collect()}
    assert found == {("1980-01-01", "station b", "x", "number"), ("never", "date", "never", "date"), (None, "date", None, "date"), ("1980-01-02", "station b", "5y", "number"), ("station b", "Latitude", "95", "latitude"), ("elsewhere", "Longitude", "east", "longitude")}
    got = tables.load(spark, f"{files}/odd.csv", f"{files}/odd_places.csv")
    assert got.panel.count() == 6
    assert got.observed.get == {"n_rows": 5, "n_without_date": 2, "n_unreadable": 2}
    both = got.panel.join(got.panel.groupBy("station").agg({"value": "avg"}), "station").unionByName(got.panel.selectExpr("*", "0D AS `avg(value)`"))
    assert both.count() == 12  # counters may be in a plan more than once
    with pytest.raises(tables.SourceError, match="'date': 2, 'latitude': 1, 'longitude': 1, 'number': 2"):
        tables.load(spark, f"{files}/odd.csv", f"{files}/odd_places.csv", strict=True)
    assert tables.rejects(spark, f"{files}/panel.csv").where("reason <> 'number'").count() == 0


def test_rolling_fill_reuses_the_seeds_model(spark, files, monkeypatch):
    from lacuna.operators.forest import InitialisedForest

    small = {"n_estimators": 3, "max_iter": 1, "max_depth": 3, "update": "jacobi", "cache": f"file://{files}/models"}
    fits = []
    fit = InitialisedForest._fit
    monkeypatch.setattr(InitialisedForest, "_fit", lambda self, panel: fits.append(1) or fit(self, panel))
    runs = []
    for k in range(2):
        focused.fill_rolling(spark, f"{files}/panel.csv", f"{files}/places.csv", f"{files}/matrix.csv", f"file://{files}/rolling{k}", 1980, 1980, 1, 10.0, **small)
        back = spark.read.option("header", True).csv(f"file://{files}/rolling{k}/imputed_1980_to_1980.csv")
        runs.append(sorted(tuple(r) for r in back.select("date", "paramanpur", "stationb").collect()))
    assert len(fits) == 1 and runs[0] == runs[1] and len(runs[0]) == 200
    assert all(None not in r for r in runs[0])
