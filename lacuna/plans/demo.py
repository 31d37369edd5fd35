"""Panels, places and edges made from the order tables, for queries and benchmarks.

Stations are the suppliers' nations (or regions), a reading is the quantity shipped on a day, on a dense
calendar of 1995 to 2001. A fixed outage mask takes ten of every 97 days from each station."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_number, parse_coordinate

FIRST, LAST = "1995-01-01", "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_name(key: str):
    return F.concat(F.lit("s"), F.lpad(F.col(key).cast("string"), 2, "0"))


def keys(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """(key, station)."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    if by == "region":
        own = own.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey"), "key").select(F.col("n_regionkey").alias("key"))
    return own.distinct().withColumn("station", station_name("key"))


def panel(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """(station, date, dn, value)."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("key"))
    if by == "region":
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey")
        supplier = supplier.join(nation, "key").select("l_suppkey", F.col("n_regionkey").alias("key"))
    shipped = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    sums = shipped.join(supplier, "l_suppkey").groupBy("key", "date").agg(F.sum("l_quantity").alias("value"))
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))).alias("date"))
    cells = keys(spark, sf_dir, by).crossJoin(F.broadcast(calendar)).join(sums, ["key", "date"], "left")  # a calendar has 2,557 rows
    dn = day_number(F.col("date"))
    outage = F.pmod(dn + 37 * F.col("key"), F.lit(97)) < 10
    return cells.select("station", "date", dn.alias("dn"), F.when(~outage, F.col("value")).alias("value"))


def coordinates(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """(station, latitude_text, longitude_text, latitude, longitude) in degrees, minutes and seconds."""
    k = F.col("key")
    text = lambda d, m, s: F.concat(d.cast("string"), F.lit("°"), F.lpad(m.cast("string"), 2, "0"), F.lit("'"), F.lpad(s.cast("string"), 2, "0"), F.lit('"'))
    placed = keys(spark, sf_dir, by).select("station", text(18 + k % 7, (k * 13) % 60, (k * 29) % 60).alias("latitude_text"), text(75 + k % 11, (k * 17) % 60, (k * 7) % 60).alias("longitude_text"))
    return placed.withColumn("latitude", parse_coordinate(F.col("latitude_text"), True)).withColumn("longitude", parse_coordinate(F.col("longitude_text"), False))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 matrix of nations: one of a lower key in the same region is upstream; codes V0 to V24."""
    nation = table(spark, sf_dir, "nation")
    other = nation.select(F.col("n_nationkey").alias("up"), F.col("n_regionkey").alias("region"))
    cells = nation.join(other, nation.n_regionkey == other.region).groupBy("n_nationkey").pivot("up", list(range(25))).agg(F.max((F.col("up") <= F.col("n_nationkey")).cast("int")))
    return cells.select(F.concat(F.lit("V"), F.col("n_nationkey")).alias("code"), station_name("n_nationkey").alias("Name of site"), *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"V{k}") for k in range(25)])
