import zlib
from functools import partial

import numpy as np
import pyarrow as pa

from lacuna.llm import quality

SF = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in quality.op1_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs
    for d, r in list(rows.items())[:500]:
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [(r["quality"], rows[r["doc_id"]]["score"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    y, s = np.array([a for a, _ in held]), np.array([b for _, b in held])
    assert auc(y, s) > 0.99
    assert ((s >= 0.7) == y).mean() > 0.97


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = sorted(map(tuple, quality.classify(docs, labels).collect()))
    b = sorted(map(tuple, quality.classify(docs.drop("lang", "source", "n_chars"), turned).collect()))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "some words"), (3, "x" * 3_000_000), (4, "!!" * 1000), (5, "\n\n\n"), (6, "é ü ß " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS x", "3 AS quality")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (6, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    none = quality.classify(docs, labels.where("quality = 7")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two three.", "", None, "ÉÉ | | a\na\na", "word " * 500, "A!! B!!"]
    together = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)
    assert np.isfinite(together).all()
    column = {n: k for k, n in enumerate(quality.FEATURES)}
    assert together[0, column["distinct"]] == 0.75
    assert together[0, column["same_as_last"]] == 0.25
    assert together[4, column["top_word"]] == 1


def test_risk_is_unbiased_with_few_negatives():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    good, bad = rng.normal(0, 1, (3000, d)), rng.normal(0, 1, (3000, d)) + 3 * np.eye(d)[0]
    unlabelled = np.concatenate([good[1500:2900], bad[:350]])
    network = quality.Network(good[:1500], unlabelled, 0.8)
    assert (network.scores(good[2900:]) > network.scores(bad[2900:]).mean()).mean() > 0.9


def test_keep_good_without_positives(spark):
    docs = spark.createDataFrame([(k, f"some text number {k}") for k in range(20)], "doc_id long, text string")
    kind = "doc_id long, quality int, toxic int"
    for labels in ([], [(k, 0, 0) for k in range(20)]):
        assert quality.keep_good(docs, spark.createDataFrame(labels, kind)).count() == 20


def plain_risk(w, xp, xu, prior):
    """The parts of the risk, a row at a time."""
    value = lambda x: float(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0])
    loss = lambda z: np.log(1 + np.exp(-z))
    good = prior * sum(loss(value(x)) for x in xp) / len(xp)
    bad = sum(loss(-value(x)) for x in xu) / len(xu) - prior * sum(loss(-value(x)) for x in xp) / len(xp)
    return good, bad


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    seen = set()
    for prior, shift in ((0.3, 0.0), (0.9, 0.0), (0.95, 3.0)):
        xp, xu = rng.normal(shift, 1, (12, 5)), rng.normal(-shift, 1, (20, 5))
        w = [rng.normal(0, 1, (5, 3)), rng.normal(0, 1, 3), np.abs(rng.normal(0, 2, 3)), np.zeros(1)]
        if shift:
            w[0] = np.abs(w[0])
        negative, grads = quality.risk_gradient(w, xp, xu, prior)
        good, bad = plain_risk(w, xp, xu, prior)
        assert np.isclose(negative, bad)
        seen.add(bad >= 0)
        for k in range(4):
            for at in np.ndindex(w[k].shape):
                ends = []
                for step in (1e-6, -1e-6):
                    moved = [x.copy() for x in w]
                    moved[k][at] += step
                    g, b = plain_risk(moved, xp, xu, prior)
                    ends.append(g + b if bad >= 0 else -b)
                assert np.isclose((ends[0] - ends[1]) / 2e-6, grads[k][at], atol=1e-5)
    assert seen == {True, False}


def test_planted_priors():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    good, bad = rng.normal(0, 1, (5000, d)), rng.normal(0, 1, (5000, d)) + 4 * np.eye(d)[0]
    for prior in (0.2, 0.5, 0.8, 0.95):
        n = int(3000 * prior)
        unlabelled = np.concatenate([good[2000 : 2000 + n], bad[: 3000 - n]])
        assert abs(quality.estimated_prior(good[:2000], unlabelled) - prior) < 0.05
    assert quality.estimated_prior(good[:1], bad[:5]) == 0.5


def test_prior_of_documents_needs_no_negative_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = sorted(map(tuple, quality.classify(docs, labels).collect()))
    b = sorted(map(tuple, quality.classify(docs, labels.where("quality = 1")).collect()))
    assert a == b


def test_steps_follow_the_gradient_of_all_rows(spark, monkeypatch):
    """Sums over a table are the batch's gradient, whatever its partitions; rows beyond the sample count."""
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    positive, unlabelled = rng.normal(0, 1, (50, d)), rng.normal(0.5, 1, (300, d)).astype(np.float32).astype(float)
    network = quality.Network(positive, unlabelled[:40], 0.4, 50)
    table = spark.createDataFrame([(x.tolist(),) for x in unlabelled], "x array<float>").repartition(7)
    size = sum(x.size for x in network.w) + 2
    sums = quality._summed(table, size, partial(quality.unlabelled_sums, network, network.w))
    assert sums[-1] == 300
    scaled, p = network._scaled(unlabelled), network._scaled(positive)
    negative, want = quality.risk_gradient(network.w, p, scaled, 0.4)
    hidden = np.tanh(p @ network.w[0] + network.w[1])
    assert np.isclose(sums[-2] / 300 - 0.4 * np.logaddexp(0, hidden @ network.w[2] + network.w[3]).mean(), negative, atol=1e-5)
    before = [x.copy() for x in network.w]
    quality.refine(network, table, positive, 0.4, 1)
    want[0] += 1e-4 * before[0]
    want[2] += 1e-4 * before[2]
    for k, g in enumerate(want):  # Adam's first step goes along the gradient's signs
        sure = np.abs(g) > 1e-4
        assert sure.any() and (np.sign(before[k] - network.w[k])[sure] == np.sign(g)[sure]).all()
    again = quality.Network(positive, unlabelled[:40], 0.4, 50)
    quality.refine(again, table.repartition(2), positive, 0.4, 1)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(network.w, again.w))


def test_prior_is_counted_over_all_rows(spark):
    """Unlabelled rows outside of the sample decide: a sample of good rows alone doesn't hide the others."""
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    good, bad = rng.normal(0, 1, (4000, d)), rng.normal(0, 1, (3000, d)) + 4 * np.eye(d)[0]
    everything = np.concatenate([good[2000:3000], bad])
    sample = np.concatenate([good[3000:], bad[:100]])
    count = lambda networks: quality._counts(networks, everything)
    assert 0.2 < quality.estimated_prior(good[:2000], sample, count) < 0.5 < 0.8 < quality.estimated_prior(good[:2000], sample)
