import random
import re
from collections import Counter, defaultdict

import pytest

from lacuna.llm import mixing


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def rows_of(seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(1500):
        source = rng.choice(["a"] * 20 + ["b", "é", "B", None, "", "tiny"])
        rows.append((k, source, " ".join("w" * rng.randrange(1, 9) for _ in range(int(rng.paretovariate(0.9)) % 900))))
    return rows + [(9000, "none", None), (9001, "none", " \n"), (9002, "huge", "z " * 200_000), (None, "a", "x y"), (9003, "a", "one two"), (9003, "a", "one two")]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_copies(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS target", "3 AS copies")
    out = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((d, s, size(t)) for d, s, t in rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    want = water(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1.5 * longest[s], 0.02 * want[s])
    assert out == mixing.mix(df).collect() or Counter(out) == Counter(mixing.mix(df).collect())


def test_emit_repeats_rows(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS __size_", "2 AS copies")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], size(r["text"])) for r in mixing.emit(df).collect())
    assert got == +want
    assert mixing.emit(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0 and mixing.emit(df).count() == 0
