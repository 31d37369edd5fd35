"""Runs from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocks, spatial
from ..operators.forest import Settings
from ..sources import tables
from . import evaluation


def _settings(inputs: tables.Inputs, **options) -> Settings:
    stations = inputs.stations.select("station")
    return Settings(spatial.distances(stations, inputs.stations), spatial.connectivity(stations, inputs.edges), initialization_method="historical_mean", **options)


def fill_focused(spark: SparkSession, panel_path: str, coordinates_path: str, contributors_path: str | None, output: str, start: str = "1980-01-01", end: str = "1990-12-31", seed_days: int = 1826, **options) -> DataFrame:
    """Fill a range of dates from its best window and write it as CSV."""
    inputs = tables.load(spark, panel_path, coordinates_path, contributors_path)
    filled = blocks.seed_and_fill(inputs.panel, start, end, seed_days, _settings(inputs, **options))
    stations = [r["station"] for r in inputs.stations.select("station").orderBy("station").collect()]
    tables.write_wide(filled, f"{output}/imputed_{start}_to_{end}.csv", stations, calendar=inputs.calendar)
    return filled


def fill_rolling(spark: SparkSession, panel_path: str, coordinates_path: str, contributors_path: str | None, output: str, first_year: int = 1980, last_year: int = 1990, years: int = 5, min_percent: float = 50.0, **options) -> DataFrame:
    """Fill whole years, blocks of ``years`` outwards from the most complete run of them, and write them as CSV. ``cache`` (a folder) keeps the seed's model for other runs."""
    inputs = tables.load(spark, panel_path, coordinates_path, contributors_path)
    filled = blocks.rolling(inputs.panel, first_year, last_year, years, min_percent, _settings(inputs, **options))
    stations = [r["station"] for r in inputs.stations.select("station").orderBy("station").collect()]
    tables.write_wide(filled, f"{output}/imputed_{first_year}_to_{last_year}.csv", stations, calendar=inputs.calendar)
    return filled


def evaluate_focused(spark: SparkSession, panel_path: str, coordinates_path: str, contributors_path: str | None, output: str, start: str = "1980-01-01", end: str = "1990-12-31", years: int = 3, methods=None, **options) -> DataFrame:
    """Compare all methods and write, in a folder with the time in its name, the table of results as CSV and each method's plots."""
    inputs = tables.load(spark, panel_path, coordinates_path, contributors_path)
    folder = tables.stamped(output)
    plot = lambda cells, method, gap: tables.write_plots(cells, folder, method, gap)
    results = evaluation.evaluate(inputs.panel, start, end, _settings(inputs, **options), years=years, methods=methods, plot=plot)
    tables.write_results(results, f"{folder}/evaluation_results_{start}_to_{end}.csv")
    tables.summary(results.drop("error")).show(1000, False)
    return results
