import math

import pytest
from pyspark.sql import functions as F

from lacuna.functions import clean_station_name, day_of_year_cos, day_of_year_sin, geodesic_km, is_temporal, parse_coordinate, scrub, to_number


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, want", [(" Parm anpur ", "paramanpur"), ("Bamni'dih", "bamnidhi"), ('A"b`c\td', "abcd"), (None, "none"), ("", "")])
def test_names(spark, raw, want):
    assert one(spark, raw, clean_station_name) == want


def test_numeric_name(spark):
    assert one(spark, 12, clean_station_name, "int") == "12"


@pytest.mark.parametrize("raw, lat, lon", [
    ("21°50'02\"", 21 + 50 / 60 + 2 / 3600, 21 + 50 / 60 + 2 / 3600), ("21.5", 21.5, 21.5), ("-21 30", -21.5, -21.5), ("-21 N", 21.0, 21.0),
    ("21 S", -21.0, 21.0), ("21 W", 21.0, -21.0), ("181", None, None), ("91", None, 91.0), ("abc", None, None), ("7 8 9 10", 7 + 8 / 60 + 9 / 3600, 7 + 8 / 60 + 9 / 3600), (None, None, None),
])
def test_coordinates(spark, raw, lat, lon):
    for want, is_latitude in ((lat, True), (lon, False)):
        got = one(spark, raw, lambda c: parse_coordinate(c, is_latitude))
        assert got == (pytest.approx(want) if want is not None else None)


def test_numeric_and_strict_coordinates(spark):
    assert one(spark, -45.25, parse_coordinate, "double") == -45.25
    with pytest.raises(Exception, match="not a coordinate"):
        one(spark, "abc", lambda c: parse_coordinate(c, True, True))


def test_numbers(spark):
    assert [one(spark, x, to_number) for x in ("1", " 2.5 ", "NaN", "x", "", None)] == [1.0, 2.5, None, None, None, None]
    assert [one(spark, x, scrub, "double") for x in (None, float("nan"), float("inf"), -float("inf"), 2.0)] == [0, 0, 0, 0, 2]


def test_calendar(spark):
    row = spark.sql("SELECT DATE '1984-12-31' d, DATE '1985-12-31' e").select(day_of_year_sin(F.col("d")), day_of_year_cos(F.col("e"))).first()
    assert row[0] == pytest.approx(math.sin(2 * math.pi * 366 / 366), abs=1e-12)
    assert row[1] == pytest.approx(math.cos(2 * math.pi * 365 / 366))
    assert is_temporal("month_1") and not is_temporal("monthly")


def test_distances(spark):
    places = [(50 + 3 / 60 + 58.76 / 3600, -(5 + 42 / 60 + 53.10 / 3600), 58 + 38 / 60 + 38.48 / 3600, -(3 + 4 / 60 + 12.34 / 3600)), (0.0, 0.0, 0.0, 1.0), (10.0, 20.0, 10.0, 20.0), (None, 1.0, 2.0, 3.0), (0.0, 0.0, 1.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(places, "a double, b double, c double, d double").select(geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(969.954166, abs=1e-4)
    assert got[1] == pytest.approx(111.319491, abs=1e-5)
    assert got[2] == 0 and got[3] is None
    assert got[4] == pytest.approx(110.574389, abs=1e-5)
