"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words; no target may exceed ``max_copies`` times the source's
size, and what is cut off is shared again by weight (:func:`targets`). Every document of a source then
expects ``target / size of the source`` copies. Along an order of the source's documents those
expectations are summed, one offset is added, and a document is emitted once for each integer that its
interval crosses: :func:`copies`. The order puts documents of like sizes together, so that the words
taken come within about one document of the target.

The running sum isn't made by one window over a source, which may hold a third of all rows: documents
fall into strata (two leading digits of the size, 256 hashed parts each); strata are counted before
the shuffle, their starts are summed over at most some thousands of counts a source, and only ranks
within a stratum need its rows.

Null texts have size 0, a null source is a source of its own and comes last, null and repeated doc_ids
are documents like others (rows equal in all of doc_id, source and size are interchangeable), and an
empty table gives an empty table. Columns of the input with an output's name are replaced by
:func:`mix`; :func:`emit` keeps all columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fits_broadcast, materialize, release, shielded

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def word_count(text: str) -> Column:
    """Runs of other than ASCII white space: as many as there are white-space bytes that a run follows, and one at the start."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size: a row a source) with the target of each source.

    Sharing the excess again until nobody exceeds a limit ends at ``least(limit, level * weight)`` for
    one level; sources reach their limits in the order of limit / weight, so the level follows from
    sums along that order. One row a source meets in one task, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double")
    with_level = ranked.withColumn("most", F.col("source_size") * max_copies).withColumn("ratio", F.col("most") / F.col("weight")).withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.struct(-F.col("ratio"), F.col("level")))).over(everyone)["level"]
    return with_level.withColumn("final", final).select("source", "source_size", F.when(F.col("most") <= F.col("final") * F.col("weight"), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _offset() -> Column:
    """In [0, 1), from the source's name, so that reruns agree."""
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sized`` (doc_id, source, size; read several times, so a written table) with source_size, target and copies."""
    part = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("n"))), 1, 2)
    digits = F.col("size").cast("string")
    keyed = sized.withColumn("stratum", F.concat_ws("", F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 2), part))
    strata = keyed.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goals = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    earlier = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    begun = strata.withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "n", "words")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "stratum").orderBy("size", "doc_id")) - 1)
    there = begun.select(F.col("source").alias("__source"), F.col("stratum").alias("__stratum"), "begin", "source_size", "target")
    joined = ranked.join(there, F.col("source").eqNullSafe(F.col("__source")) & (F.col("stratum") == F.col("__stratum")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    place = (F.col("begin") + F.col("rank")).cast("double")
    crossed = F.floor(_offset() + (place + 1.0) * rate) - F.floor(_offset() + place * rate)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(max_copies)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies. Reads the texts once."""
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    return copies(sized, weights, max_copies)


@shielded
def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Decisions are joined by (doc_id, source, size); of equal rows each takes the same number, counted
    down over the group so that the sum is kept.
    """
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    decided = materialize(copies(sized, weights, max_copies).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")), "mix-copies")
    release(sized)
    repeated = not decided.where("__rows > 1").isEmpty()
    columns = docs.columns
    left = docs.withColumn("__size", word_count("text"))
    right = decided.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__s"), "__copies", "__rows")
    if fits_broadcast(decided.count(), 96):
        right = F.broadcast(right)
    met = left.join(right, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__s")))
    if repeated:
        within = Window.partitionBy("__doc", "__source", "__s").orderBy(F.xxhash64(*columns))
        met = met.withColumn("__n", F.row_number().over(within)).withColumn("__copies", F.floor(F.col("__n") * F.col("__copies") / F.col("__rows")) - F.floor((F.col("__n") - 1) * F.col("__copies") / F.col("__rows")))
    times = F.when(F.col("__copies") > 0, F.array_repeat(F.lit(1), F.col("__copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return met.select(*columns, F.explode(times).alias("__copy")).drop("__copy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, lpad(length(size::VARCHAR)::VARCHAR, 2, '0') || substr(size::VARCHAR, 1, 2)
            || substr(md5(COALESCE(doc_id::VARCHAR, 'n')), 1, 2) AS stratum FROM sized
), sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ratios AS (
  SELECT *, source_size * 3 AS most, source_size * 3 / weight::DOUBLE AS ratio FROM sources
), levels AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(most) OVER (ORDER BY ratio, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (SUM(weight) OVER (ORDER BY ratio, source COLLATE "C" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ratios
), goals AS (
  SELECT source, source_size, CASE WHEN most <= final * weight THEN most::DOUBLE ELSE final * weight END AS target
  FROM (SELECT *, (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1) AS final FROM levels)
), placed AS (
  SELECT k.doc_id, k.source, k.size, g.source_size, g.target,
         (row_number() OVER (PARTITION BY k.source ORDER BY stratum, size, doc_id NULLS FIRST) - 1)::DOUBLE AS place,
         ('0x' || substr(md5(COALESCE('s' || k.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS begin_at,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0 END AS rate
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (size * LEAST(floor(begin_at + (place + 1.0::DOUBLE) * rate) - floor(begin_at + place * rate), 3))::BIGINT AS taken
FROM placed
"""
