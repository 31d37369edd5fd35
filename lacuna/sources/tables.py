"""Files of the gap-filling engine: CSV in and out, Parquet through Spark itself."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_station_name, is_temporal, parse_coordinate, to_number
from ..operators import panel as panels
from ..operators import spatial

#: Headers of the coordinate file and the names they get.
RENAMES = {"Latitude (N)": "latitude", "Longitude (E)": "longitude", "Name of site": "station", "Latitude": "latitude", "Longitude": "longitude", "Station": "station"}
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")


class SourceError(ValueError):
    """A file can't be used."""


@dataclass
class Inputs:
    #: station, date, dn, value
    panel: DataFrame
    #: station, latitude, longitude
    stations: DataFrame
    #: station, contributor; None without a contributor file
    edges: DataFrame | None
    #: date and the calendar columns that the file holds itself
    calendar: DataFrame
    #: code, station; empty without codes in the coordinate file
    codes: DataFrame
    #: what the first pass over the panel file counts: n_rows, n_without_date, n_unreadable; see :func:`rejects` for the texts
    observed: Observation | None = None


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def parse_date(text):
    """A date from ISO or day-first text; null if it is neither."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS]).cast("date")


#: Texts that say that a reading is missing; any other text that is no number is rejected.
MISSING = ("", "nan", "na", "n/a", "null", "none", "-")


def _unreadable(text: Column, value: Column) -> Column:
    """Whether a text says something and ``value`` didn't come of it."""
    return text.isNotNull() & ~F.lower(F.trim(text)).isin(*MISSING) & value.isNull()


def rejects(spark: SparkSession, panel_path: str, coordinates_path: str | None = None) -> DataFrame:
    """(file, key, column, text, reason) of what :func:`load` can't read: dates (their rows are left out), numbers and places (null).

    ``key`` is the row's date or station as the file has it."""
    raw = _csv(spark, panel_path)
    first, stations = raw.columns[0], [c for c in raw.columns[1:] if not is_temporal(c)]
    col = lambda c: F.col(f"`{c}`")
    cell = lambda c, bad, reason: F.struct(F.lit(c).alias("column"), col(c).alias("text"), F.when(bad, reason).alias("reason"))
    found = [(raw, panel_path, first, [cell(first, parse_date(col(first)).isNull(), "date"), *[cell(c, _unreadable(col(c), to_number(col(c))), "number") for c in stations]])]
    if coordinates_path:
        places = _csv(spark, coordinates_path)
        names = {new: old for old, new in RENAMES.items() if old in places.columns}
        found.append((places, coordinates_path, names["station"], [cell(names[c], parse_coordinate(col(names[c]), c == "latitude").isNull(), c) for c in ("latitude", "longitude")]))
    parts = [t.select(F.lit(path).alias("file"), col(key).alias("key"), F.explode(F.filter(F.array(*cells), lambda x: x["reason"].isNotNull())).alias("c")).select("file", "key", "c.*") for t, path, key, cells in found]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_wide(spark: SparkSession, path: str, observed: Observation | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """The panel file: date, stations (cleaned names, numbers or null) and calendar columns. Rows without a readable date are left out; ``observed`` counts them."""
    try:
        raw = _csv(spark, path)
    except Exception as e:
        raise SourceError(f"the panel can't be read: {e}") from e
    first, rest = raw.columns[0], raw.columns[1:]
    stations = [c for c in rest if not is_temporal(c)]
    if not stations:
        raise SourceError("the panel has no station column")
    names = spark.createDataFrame([(k, c) for k, c in enumerate(stations)], "k int, name string").select("k", clean_station_name(F.col("name")).alias("clean")).orderBy("k").collect()
    cleaned = [r["clean"] for r in names]
    if len(set(cleaned)) < len(cleaned):
        raise SourceError(f"columns with one name after cleaning: {sorted({c for c in cleaned if cleaned.count(c) > 1})}")
    temporal = [c for c in rest if is_temporal(c)]
    number = lambda c: to_number(F.col(f"`{c}`"))
    if observed is not None:
        bad = sum((_unreadable(F.col(f"`{c}`"), number(c)).cast("int") for c in stations), F.lit(0))
        raw = raw.observe(observed, F.count(F.lit(1)).alias("n_rows"), F.count_if(parse_date(F.col(f"`{first}`")).isNull()).alias("n_without_date"), F.coalesce(F.sum(bad), F.lit(0)).alias("n_unreadable"))
    wide = raw.select(parse_date(F.col(f"`{first}`")).alias("date"), *[number(c).alias(n) for c, n in zip(stations, cleaned)], *[number(c).alias(c) for c in temporal])
    return wide.where("date IS NOT NULL"), cleaned, temporal


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """station, raw latitude and longitude, v_code if the file has it."""
    try:
        raw = _csv(spark, path)
    except Exception as e:
        raise SourceError(f"the coordinates can't be read: {e}") from e
    renamed = raw
    for old, new in RENAMES.items():
        if old in renamed.columns and old != new:
            renamed = renamed.withColumnRenamed(old, new)
    for needed in ("station", "latitude", "longitude"):
        if needed not in renamed.columns:
            raise SourceError(f"the coordinate file has no column for {needed}")
    return renamed.withColumn("station", clean_station_name(F.col("station")))


def read_contributors(spark: SparkSession, path: str) -> DataFrame:
    """station, contributor from a 0/1 matrix with codes in its first column."""
    raw = _csv(spark, path)
    return spatial.edges_from_matrix(raw, raw.columns[0], "Name of site")


def load(spark: SparkSession, panel_path: str, coordinates_path: str, contributors_path: str | None = None, strict: bool = False) -> Inputs:
    """All inputs, for the stations that are in both the panel and the coordinate file.

    ``strict`` makes a date, number or coordinate that can't be read an error, with their counts; otherwise the row is left
    out, the reading missing, the place unknown, and ``observed`` has the panel's counts once an action has read it. A
    contributor file that can't be used gives no edges."""
    if strict and (counts := {r["reason"]: r["n"] for r in rejects(spark, panel_path, coordinates_path).groupBy("reason").agg(F.count("*").alias("n")).collect()}):
        raise SourceError(f"unreadable texts: {dict(sorted(counts.items()))}")
    observed = Observation("panel")
    wide, stations, temporal = read_wide(spark, panel_path, observed)
    raw = read_coordinates(spark, coordinates_path)
    known = {r["station"] for r in raw.select("station").distinct().collect()}  # a row a station
    both = sorted(set(stations) & known)
    places = raw.where(F.col("station").isin(both))
    coordinates = places.select("station", parse_coordinate(F.col("latitude"), True, strict).alias("latitude"), parse_coordinate(F.col("longitude"), False, strict).alias("longitude"))
    coordinates = spatial.first_of_each(coordinates, "station", "latitude", "longitude")
    codes = places.select(F.col("v_code").alias("code"), "station") if "v_code" in raw.columns else spark.createDataFrame([], "code string, station string")
    edges = None
    if contributors_path:
        try:
            edges = spatial.keep_known(read_contributors(spark, contributors_path), coordinates)
            edges.schema  # noqa: B018  resolved here, so that a wrong file shows
        except Exception:
            edges = None
    return Inputs(panels.to_long(wide, both), coordinates, edges, wide.select("date", *temporal), spatial.first_of_each(codes, "station", "code"), observed)


def write_wide(panel: DataFrame, path: str, stations: list[str], value: str = "filled", calendar: DataFrame | None = None) -> None:
    """One CSV of date, stations and calendar features, ordered by date."""
    wide = panels.to_wide(panel, stations, value)
    more = [c for c in calendar.columns if c not in wide.columns] if calendar is not None else []
    if more:
        wide = wide.join(calendar.select("date", *more), "date", "left")
    wide.orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.orderBy("gap_scenario", "method").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary(results: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded for display."""
    numbers = {c for c, kind in results.dtypes if kind == "double"}
    return results.select(*[F.round(c, digits).alias(c) if c in numbers else F.col(c) for c in results.columns]).orderBy("gap_scenario", "method")


def stamped(base: str, now: datetime.datetime | None = None) -> str:
    """``base`` with the time, for an output folder of its own."""
    return f"{base}_{(now or datetime.datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def scatter_data(cells: DataFrame, truth: str = "true_value", pred: str = "filled") -> DataFrame:
    """True and predicted values of the artificial gaps."""
    return cells.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select("station", "date", F.col(truth).alias("true_value"), F.col(pred).alias("predicted"))


def series_data(cells: DataFrame, stations: int = 3, seed: int = 42) -> DataFrame:
    """Whole series of some stations that have gaps, drawn by hash."""
    drawn = cells.where("is_gap").select("station").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "station"))).limit(stations)
    return cells.join(F.broadcast(drawn), "station", "left_semi").select("station", "date", "true_value", "is_gap", "filled")


def grid(points: DataFrame, bins: int) -> DataFrame:
    """(true_value, predicted, n): the mean point of each cell of a grid over all of them."""
    ends = points.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("true_value", "predicted") for f in (F.min, F.max)])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_min")) * bins / F.greatest(F.col(f"{c}_max") - F.col(f"{c}_min"), F.lit(1e-12))), F.lit(bins - 1))
    placed = points.crossJoin(F.broadcast(ends))  # one row
    return placed.groupBy(cell("true_value").alias("x"), cell("predicted").alias("y")).agg(F.avg("true_value").alias("true_value"), F.avg("predicted").alias("predicted"), F.count("*").alias("n")).drop("x", "y")


def plot_folder(folder: str, method: str, gap: int) -> str:
    return f"{folder}/gap_{gap}d/plots_{re.sub('[^A-Za-z0-9_]+', '_', method)}"


def write_plots(cells: DataFrame, folder: str, method: str, gap: int) -> list[str]:
    """What a method's two kinds of plot show, as CSV, and the plots themselves where :func:`render` can draw."""
    out = plot_folder(folder, method, gap)
    scatter_data(cells).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/scatter.csv")
    series_data(cells).orderBy("station", "date").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/series.csv")
    return render(cells, folder, method, gap)


def render(cells: DataFrame, folder: str, method: str, gap: int, bins: int = 200) -> list[str]:
    """PNG files of both kinds of plot, where matplotlib is installed; else none. All points count: they meet in cells of a grid of ``bins``."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return []
    import os

    out = plot_folder(folder, method, gap).removeprefix("file://")
    os.makedirs(out, exist_ok=True)
    files = []
    points = grid(scatter_data(cells), bins).toPandas()  # bins x bins rows at most
    figure = plt.figure(figsize=(8, 8))
    plt.scatter(points.true_value, points.predicted, s=4 * points.n**0.5, alpha=0.6)
    plt.xlabel("true"), plt.ylabel("predicted"), plt.title(f"{method}, {gap} days")
    files.append(f"{out}/scatter.png")
    figure.savefig(files[-1])
    plt.close(figure)
    for station, rows in series_data(cells).toPandas().groupby("station"):
        rows = rows.sort_values("date")
        figure = plt.figure(figsize=(15, 6))
        plt.plot(rows.date, rows.true_value, label="true")
        plt.scatter(rows.date[rows.is_gap], rows.filled[rows.is_gap], color="red", label=method)
        plt.legend(), plt.title(f"{station}, {gap} days")
        files.append(f"{out}/{station}.png")
        figure.savefig(files[-1])
        plt.close(figure)
    return files


__all__ = ["Inputs", "SourceError", "load", "read_wide", "read_coordinates", "read_contributors", "parse_date", "write_wide", "write_results", "summary", "stamped", "scatter_data", "series_data", "grid", "plot_folder", "write_plots", "render"]
