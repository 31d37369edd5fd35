import random
import re

import numpy as np

from lacuna.llm import decontaminate as D


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for k, y in enumerate(b, 1):
            old, row[k] = row[k], (old + 1 if x == y else max(row[k], row[k - 1]))
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 90)), rng.integers(0, 5, rng.integers(0, 90))
        assert D.lcs_length(a, b) == lcs(a.tolist(), b.tolist())


def world(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    common = ["the", "of", "and", "to"]
    sentence = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{sentence(rng.choice([20, 40]))}. {sentence(6)}.") for k in range(30)] + [(90, None), (91, ""), (92, "odd pair"), (93, sentence(300))]
    docs = []
    for d in range(200):
        text = sentence(rng.choice([30, 200, 900]))
        if d < 30:
            w = text.split()
            at = rng.randrange(len(w))
            own = items[d][1].split()
            if d % 3 == 0:  # a paraphrase: a fifth of the words before the answer change
                for k in rng.sample(range(len(own) - 6), len(own) // 5):
                    own[k] = rng.choice(vocabulary)
            text = " ".join(w[:at] + own + w[at:])
        docs.append((d, text))
    docs += [(300, None), (301, ""), (302, "an ODD, pair here"), (303, items[33][1]), (None, items[1][1]), (304, "word " * 40000 + items[2][1].upper())]
    return items, docs


def test_finds_planted_and_nothing_else(spark):
    items, docs = world()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS key")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()}
    want = {(d, d) for d in range(30)} | {(302, 92), (303, 93), (None, 1), (304, 2)}
    assert got == want
    assert got == brute(docs, items)


def brute(docs, items):
    """Leaks of every document and item, by the common subsequence at every fourth word: no vectors and no candidates."""
    found, answers = set(), [tokens(re.split(r"[.!?\n]+", (t or "").strip().rstrip(".!?"))[-1]) for _, t in items]
    number = {}
    own = [np.array([number.setdefault(w, len(number) + 1) for w in tokens(t)]) for _, t in items]
    for d, text in docs:
        w = np.array([number.get(x, 0) for x in tokens(text)], np.int64)
        for (i, _), item, answer in zip(items, own, answers):
            n = len(item)
            if not n or (np.isin(item, w).sum() < D.LCS_LIKELY * n if n >= D.LEAST else not np.isin(item, w).all()):
                continue  # too few of its words are anywhere
            if n < D.LEAST:
                if any((w[a : a + n] == item).all() for a in range(len(w) - n + 1)):
                    found.add((d, i))
                continue
            ask = np.array([number[x] for x in answer])
            span = max(n, D.PASSAGE) + D.PASSAGE
            for a in range(0, max(len(w) - n, 0) + 1, 4):
                around = w[a : a + span]
                if np.isin(item, around).sum() < D.LCS_LIKELY * n:
                    continue
                if D.is_leak(n, D.lcs_length(item, around) / n, float(np.isin(ask, around).mean()) if len(ask) else 1.0):
                    found.add((d, i))
                    break
    return found


def test_whole_table_matches_brute_force(spark):
    """Every leak of the query is one by brute force, and of those at least 99 % are found (recall at COSINE)."""
    for sf in ("sf0.001", "sf0.01"):
        read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet").select(k, "text").collect()]  # noqa: B023, E731
        got = {(r["doc_id"], r["item_id"]) for r in D.op2_decontamination(spark, f"/root/testdata/{sf}").collect()}
        want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
        assert got <= want
        assert len(got) >= 0.99 * len(want)


def test_blocks_of_items(spark, monkeypatch):
    items, docs = world(2)
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 400)
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()}
    assert {(d, d) for d in range(30)} <= got


def test_clashing_columns(spark):
    items, docs = world(2)
    own = ", ".join(f"{k} AS {c}" for k, c in enumerate(("terms", "word", "share", "answer", "item", "block", "words", "lang")))
    bench, df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", own.split(", ")[0], "7 AS words", "8 AS doc_id"), spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *own.split(", "))
    plain = D.find_leaks(df.select("doc_id", "text"), bench.select("item_id", "text"))
    assert {tuple(r) for r in D.find_leaks(df, bench).collect()} == {tuple(r) for r in plain.collect()}
    assert D.drop_leaks(df, bench).columns == df.columns


def test_drop_keeps_columns(spark):
    items, docs = world()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string")
    left = D.drop_leaks(df, bench)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {*range(30), 302, 303, 304, None}


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert D.find_leaks(docs, bench).count() == 0
    assert D.find_leaks(some, bench).count() == 0
    assert D.find_leaks(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_finds_leaks_that_are_frequent(spark):
    """A paraphrase of one item in a third of the rows makes the item's own words frequent."""
    items, docs = world(3)
    rng = random.Random(4)
    own = items[0][1].split()
    for k in rng.sample(range(len(own) - 6), len(own) // 7):
        own[k] = f"other{k}"
    docs = docs[:200] + [(1000 + d, f"{docs[100 + d % 90][1]} {' '.join(own)}") for d in range(100)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()}
    assert got == {(d, d) for d in range(30)} | {(1000 + d, 0) for d in range(100)}


def test_finds_paraphrase_in_a_tiny_corpus(spark):
    items, _ = world(5)
    own = items[0][1].split()
    own[2] = "other"
    df = spark.createDataFrame([(d, " ".join(own)) for d in range(3)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, 0) for d in range(3)}
