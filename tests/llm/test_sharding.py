import hashlib
from collections import Counter

import pytest

from lacuna.llm import sharding


def plain_fill(names, size):
    """Each shard's whole preference order, then turns."""
    number = lambda n, salt: int.from_bytes(hashlib.md5(f"{salt}:{n}".encode()).digest()[:8], "big")
    orders = [[(number(n, "offset") % size + j * (number(n, "skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    assert all(len(set(o)) == size for o in orders)
    table = {}
    while True:
        for k, order in enumerate(orders):
            table[next(s for s in order if s not in table)] = k
            if len(table) == size:
                return [table[s] for s in range(size)]


def test_table_matches_plain_turns():
    for n, size in ((1, 2), (3, 7), (5, 101), (7, 211)):
        names = [f"n{k}" for k in range(n)]
        assert sharding.fill_table(names, size) == plain_fill(names, size)


def test_shares_and_losses():
    names = [f"n{k}" for k in range(20)]
    table = sharding.fill_table(names, 10007)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 10007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved / 10007 < 0.1
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 10)


def test_rows(spark):
    rows = [(k, "t") for k in range(3000)] + [(None, "a"), (None, "b"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS __s")
    out = sharding.shard(df, "doc_id").collect()
    assert len(out) == len(rows)
    table = sharding.fill_table([f"shard-{k:05d}" for k in range(64)])
    for r in out:
        key = "n" if r["doc_id"] is None else f"k{r['doc_id']}"
        assert r["shard"] == table[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE]
    assert len({r["shard"] for r in out}) == 64
    assert sharding.shard(df.limit(0), "doc_id").count() == 0


def test_whole_table(spark):
    out = sharding.op7_sharding(spark, "/root/testdata/sf0.01")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert out.where("shard IS NULL").count() == 0


def test_query_keeps_whole_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = sharding.op7_sharding(spark, "/root/testdata/sf0.001")
    assert out.columns == [*docs.columns, "shard"]
    assert out.drop("shard").exceptAll(docs).count() == 0 and out.count() == docs.count()
