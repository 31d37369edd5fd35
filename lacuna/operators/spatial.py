"""Stations in space and along the river: edges, distances, connectivity, predictor weights.

All tables here have a row a station or a pair of stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_station_name, exponential_kernel, geodesic_km, inverse_kernel, scrub


def canonical_stations(panel_stations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Stations in both tables."""
    return panel_stations.select("station").intersect(coordinates.select("station"))


def edges_from_matrix(matrix: DataFrame, code: str, name: str) -> DataFrame:
    """A 0/1 matrix (rows drain from columns that begin with V) to (station, contributor)."""
    codes = [c for c in matrix.columns if c.startswith("V")]
    names = matrix.select(F.col(f"`{code}`").alias("code"), clean_station_name(F.col(f"`{name}`")).alias("cleaned"))
    cells = matrix.select(F.col(f"`{code}`").alias("row"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in codes]).unpivot(["row"], codes, "column", "cell")
    stations = names.select(F.col("code").alias("row"), F.col("cleaned").alias("station"))
    contributors = names.select(F.col("code").alias("column"), F.col("cleaned").alias("contributor"))
    return cells.where("cell = 1").join(stations, "row").join(contributors, "column").where("station <> '' AND contributor <> ''").select("station", "contributor")


def keep_known(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """Edges between known stations."""
    known = stations.select("station")
    return edges.join(known, "station", "left_semi").join(known.withColumnRenamed("station", "contributor"), "contributor", "left_semi").select("station", "contributor")


def first_of_each(table: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first by ``order`` (null last): the same on every run."""
    by = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return table.withColumn("__row", F.row_number().over(by)).where("__row = 1").drop("__row")


def _pairs(stations: DataFrame) -> DataFrame:
    one = stations.select(F.col("station").alias("target")).distinct()
    return one.crossJoin(one.withColumnRenamed("target", "predictor"))


def distances(stations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(target, predictor, km) of all pairs; 0 on the diagonal, null for unknown places. Each pair is computed once."""
    place = coordinates.select("station", "latitude", "longitude")
    place = first_of_each(place, "station", "latitude", "longitude")
    here = lambda side: place.select(F.col("station").alias(side), F.col("latitude").alias(f"lat_{side}"), F.col("longitude").alias(f"lon_{side}"))
    half = _pairs(stations).where("target < predictor").join(here("target"), "target", "left").join(here("predictor"), "predictor", "left")
    known = half.select("target", "predictor", geodesic_km(*[F.col(c) for c in ("lat_target", "lon_target", "lat_predictor", "lon_predictor")]).alias("km"))
    back = known.select(F.col("predictor").alias("target"), F.col("target").alias("predictor"), "km")
    same = stations.select("station").distinct().select(F.col("station").alias("target"), F.col("station").alias("predictor"), F.lit(0.0).alias("km"))
    return known.unionByName(back).unionByName(same)


def connectivity(stations: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(target, predictor, w): 1 where the predictor contributes to the target. Without edges: 0."""
    pairs = _pairs(stations)
    if edges is None:
        return pairs.withColumn("w", F.lit(0.0))
    held = edges.select(F.col("station").alias("target"), F.col("contributor").alias("predictor"), F.lit(1.0).alias("held")).distinct()
    return pairs.join(held, ["target", "predictor"], "left").select("target", "predictor", F.coalesce("held", F.lit(0.0)).alias("w"))


def weights(dist: DataFrame, conn: DataFrame, kind: str = "inverse", rate: float = 0.1, alpha: float = 0.5) -> DataFrame:
    """(target, predictor, weight): kernel of the distance and connectivity, each with sum 1 or all 0, blended, and normalised again."""
    kernel = inverse_kernel(F.col("km")) if kind == "inverse" else exponential_kernel(F.col("km"), rate)
    pairs = dist.where("target <> predictor").join(conn, ["target", "predictor"], "left")
    own = Window.partitionBy("target")
    normal = lambda c: F.when(F.sum(c).over(own) > 0, F.col(c) / F.sum(c).over(own)).otherwise(0.0)
    raw = pairs.withColumn("wd", scrub(kernel)).withColumn("wc", F.coalesce("w", F.lit(0.0)))
    blended = raw.withColumn("nd", normal("wd")).withColumn("nc", normal("wc")).withColumn("blend", alpha * F.col("nd") + (1 - alpha) * F.col("nc"))
    return blended.select("target", "predictor", normal("blend").alias("weight"))
