import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lacuna.llm import jaccard


def brute(rows):
    """class and links of every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for t in s for j in holders[t])
        for j, c in shared.items():
            if c * 5 >= 4 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for t in s:
            holders[t].append(i)
    classes = defaultdict(list)
    for i in range(n):
        classes[find(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in classes.items()}
    return sorted((str(rows[i][0]), str(least[find(i)]) if sets[i] else str(rows[i][0]), links[i]) for i in range(n))


def result(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in df.collect())


def planted(seed=3, groups=12, copies=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, doc = [], 0
    common = [word() for _ in range(40)]  # a passage that all share
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for c in range(copies if g == 3 else rng.choice([1, 2, 3])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = word()
            rows.append((doc, " ".join(words + (common if g % 2 else []))))
            doc += 1
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("limits", [(100, 1000, 5000, 300), (3, 7, 5000, 3), (3, 7, 6, 3)])
def test_matches_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "LEAF", limits[0])
    for name, value in zip(("BLOCK", "GROUP", "WIDE"), limits[1:]):
        monkeypatch.setattr(jaccard, name, value)
    rows = planted() + [(900, None), (901, ""), (902, " \n"), (None, "one two three"), (903, "one two three"), (903, "one two three"), (904, "x " * 30000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS sig", "2 AS class_id", "3 AS key")
    assert result(jaccard.join(df)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert result(jaccard.op3_jaccard_join(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_keeps_groups_whole():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 20, 100))
    batches = [pa.RecordBatch.from_arrays([pa.array(values[a : a + 7])], names=["k"]) for a in range(0, 100, 7)]
    tables = list(jaccard._cut(iter(batches), 0))
    groups = [set(t.column(0).to_pylist()) for t in tables if t.num_rows]
    assert sum(map(len, groups)) == len(set(values.tolist()))
    assert sum(t.num_rows for t in tables) == 100


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_shared_passage_brings_no_comparisons(spark, monkeypatch):
    """Texts around one passage (similarity 0.57) part again: next to none of them are brought together."""
    met = []

    def counted(links):
        out = components(links)
        met.append(out.count())
        return out

    components = jaccard.components
    monkeypatch.setattr(jaccard, "components", counted)
    monkeypatch.setattr(jaccard, "GROUP", 400)
    rng = random.Random(5)
    passage = _words(rng, 25)
    rows = [(k, " ".join(_words(rng, 4) + passage + _words(rng, 4))) for k in range(700)]
    rows += [(1000 + k, " ".join(rows[k][1].split()[:-1] + _words(rng, 1))) for k in range(0, 700, 50)]  # 28 of 30 shingles
    got = result(jaccard.join(spark.createDataFrame(rows, SCHEMA)))
    assert met[0] <= 40
    assert got == brute(rows)


def test_recall_of_planted_pairs(spark, monkeypatch):
    """Pairs of 0.8 to 0.9, apart and among holders of a shared passage: 99 % are found."""
    rng = random.Random(6)
    passage, rows = _words(rng, 200), []
    for k in range(150):
        own = _words(rng, 100) + (passage if k % 2 else [])
        other = list(own)
        for at in rng.sample(range(5, 95), 2 if k % 2 == 0 else 4):
            other[at] = _words(rng, 1)[0]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    monkeypatch.setattr(jaccard, "LEAF", 20)  # so that holders are a large bucket
    monkeypatch.setattr(jaccard, "WIDE", 20)
    want, got = brute(rows), result(jaccard.join(spark.createDataFrame(rows, SCHEMA)))
    links = sum(x[2] for x in want)
    assert links >= 200
    assert sum(min(a[2], b[2]) for a, b in zip(want, got)) >= 0.99 * links


def test_contraction_keeps_components(spark):
    rng = random.Random(7)
    nodes = [bytes([k // 256, k % 256]) for k in range(300)]
    links = [(nodes[max(a, b)], nodes[min(a, b)]) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(900)) if a != b]
    df = spark.createDataFrame(links, "a binary, b binary")
    less = jaccard._contracted(df)
    root = lambda x: {bytes(r["node"]): bytes(r["root"]) for r in jaccard.components(x).collect()}
    assert root(df) == root(less)
