"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size. Shards take turns
and claim the first slot of their order that is free, until the table is full, so that shares differ
by one slot at most and a lost shard moves few keys of the others. A key's hash picks a slot: placing a
row is one lookup in a table whose size is a parameter, so it is broadcast whatever the input's size.

Null keys hash as a marker of their own and share one slot; equal keys always share a shard; an empty
table gives an empty table. A column that has the output's name already is replaced; others are kept
whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shielded

SHARDS = 64
#: Prime, and over 100 times the shards, so that shares differ by under 1 %.
TABLE_SIZE = 65537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in ``names``) of every slot."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or size < len(names):
        raise ValueError("the table's size must be a prime not below the number of shards")
    steps = [(_hash(n, "offset") % size, _hash(n, "skip") % (size - 1) + 1 if size > 2 else 1) for n in names]
    at = [offset for offset, _ in steps]
    table, left = [-1] * size, size
    while True:
        for shard, (_, skip) in enumerate(steps):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip) % size
            table[at[shard]] = shard
            left -= 1
            if not left:
                return table


def slot_of(key: str, size: int = TABLE_SIZE):
    """The slot of a key: the first 60 bits of the MD5 of its text."""
    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def lookup(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(names, size))), "__slot long, __shard int")


@shielded
def shard(df: DataFrame, key: str, names: list[str] | None = None, size: int = TABLE_SIZE, column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row, found in a broadcast table of ``size`` rows."""
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    table = F.broadcast(lookup(df.sparkSession, names, size))
    kept = [c for c in df.columns if c != column]
    placed = df.withColumn("__slot", slot_of(key, size)).join(table, "__slot", "left")
    return placed.select(*[F.col(f"`{c}`") for c in kept], F.col("__shard").alias(column))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, "doc_id")
