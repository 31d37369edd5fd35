import re
from collections import Counter

import pytest

from lacuna.llm import jaccard, quality, sharding

from .test_decontaminate import lcs, tokens
from .test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        out.append(docs.toPandas())
    return out


def test_quality_keeps_what_it_scores_high(spark, stages):
    scores = {r["doc_id"]: r["predicted"] for r in quality.op1_quality(spark, SF).collect()}
    assert set(stages[1].doc_id) == {d for d in stages[0].doc_id if scores[d]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[d], d in set(stages[1].doc_id)) for d in stages[0].doc_id if d in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_one_of_each_group_stays(stages):
    rows = list(zip(stages[1].doc_id, stages[1].text))
    classes = {int(d): int(c) for d, c, _ in brute(rows)}
    assert sorted(stages[2].doc_id) == sorted(set(classes.values()))


def test_leaks_go_and_others_stay(spark, stages):
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = set(stages[3].doc_id)
    assert kept <= set(stages[2].doc_id)
    for doc, text in zip(stages[2].doc_id, stages[2].text):
        joined = f" {' '.join(tokens(text))} "
        holds = any(f" {' '.join(i)} " in joined for i in items)
        if holds:
            assert doc not in kept
        elif doc not in kept:  # a paraphrase, then
            w = tokens(text)
            assert max(lcs(i, w[a : a + 130]) / len(i) for i in items for a in range(0, len(w), 32)) >= 0.6


def test_mix_is_near_its_targets(stages):
    before, after = stages[3], stages[4]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = Counter()
    for s, t in zip(before.source, before.text):
        words[s] += size(t)
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(words))}
    targets, open_ = {}, set(words)
    total = sum(words.values())
    while True:  # the excess of those at their limit is shared again
        level = (total - sum(3 * words[s] for s in words if s not in open_)) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * words[s]}
        if not over:
            break
        open_ -= over
    targets = {s: level * weights[s] if s in open_ else 3 * words[s] for s in words}
    taken = Counter()
    for s, t in zip(after.source, after.text):
        taken[s] += size(t)
    longest = max(size(t) for t in before.text)
    assert all(abs(taken[s] - targets[s]) <= 1.5 * longest for s in words)
    assert max(Counter(after.doc_id).values()) <= 3
    assert list(after.columns) == list(before.columns)


def test_shards(stages):
    after, last = stages[4], stages[5]
    assert Counter(after.doc_id) == Counter(last.doc_id)
    assert last.groupby("doc_id").shard.nunique().max() == 1
    assert set(last.columns) == {*after.columns, "shard"}


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "shard").collect()
    assert Counter(map(tuple, got)) == Counter(zip(stages[5].doc_id, stages[5].shard))


def test_keep_one_of_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (1, text + " more", "c"), (1, "another text with other words in it", "d"), (None, text, "e"), (2, None, "f"), (3, None, "g")]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({1: 2, 2: 1, 3: 1})


OWN = ("__key", "__doc", "__text", "__digest", "__size", "__copies", "__copy", "__slot", "__shard", "__n", "__rows", "kept__key")


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as the stages' own come through all five with their values; null ids and texts don't stop them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    strange = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src1", 0), (5, None, "en", None, 1)], docs.schema)
    rows = docs.unionByName(strange).selectExpr("*", *[f"concat('{c}', coalesce(doc_id, -1)) AS `{c}`" for c in OWN])
    for _, stage in corpus_pipeline.STAGES:
        rows = spark.createDataFrame(stage(spark, rows, SF).toArrow(), None)
        assert set(docs.columns) | set(OWN) <= set(rows.columns)
    got = rows.collect()
    assert len(got) > 100
    for r in got:
        assert all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for c in OWN)
    keyed = sharding.shard(rows, "__key", column="__slot")
    assert sorted(keyed.columns) == sorted(rows.columns)
    assert keyed.count() == len(got) and keyed.where("`__slot` NOT BETWEEN 0 AND 63").count() == 0


def test_stages_of_an_empty_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        assert rows.count() == 0
    assert "shard" in rows.columns


def test_null_ids_and_texts_by_stage(spark):
    """Each stage's rule for rows without an id or a text."""
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text, "en", "a", 1), (3, text, "en", "a", 1), (None, None, "en", "a", None), (None, None, "en", None, None), (4, "", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["text"] == text) for r in kept) == Counter({(3, True): 1, (None, False): 2, (4, False): 1})
    assert corpus_pipeline.no_benchmark(spark, docs, SF).count() == len(rows)
    mixed = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert mixed and all(r["source"] == "a" for r in mixed)  # sources without words have no share
    shards = corpus_pipeline.sharded(spark, docs, SF).where("doc_id IS NULL").select("shard").distinct().count()
    assert shards == 1
