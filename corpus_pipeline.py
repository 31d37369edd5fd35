"""From raw documents to shards: five stages, each an operator of lacuna.llm.

A stage takes (spark, docs, sf_dir) and returns documents with the columns that it got; the last one
adds the shard. Between stages documents are written to the shared folder and read again.

A null text has zero statistics, no shingles, no words and matches no benchmark item: it is judged like an
empty one, is a class of its own, and is mixed at the rate of its source (0 for a source without words). Null
doc_ids are documents like others (one of a class of copies stays, by the least id, null last) and share a shard. Repeated rows are
judged alike; of equal texts rows of the class's least doc_id stay. An empty table gives an empty table. Further
columns are kept through all stages, whatever their names; only ``shard`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import decontaminate, jaccard, mixing, quality, sharding
from lacuna.llm.storage import materialize, release


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sources' target weights take it."""
    return mixing.emit(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document, from the lookup table."""
    return sharding.shard(docs, "doc_id")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: The classifier, the SVD search and similarity classes aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
            if before is not None:
                release(before)
            before = docs
    return docs
