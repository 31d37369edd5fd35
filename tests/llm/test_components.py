import random

import pyarrow as pa

from lacuna.llm import text
from lacuna.llm.components import components


def test_against_union_find(spark):
    rng = random.Random(0)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    rows = pa.array(["a b  c\td", None, "", "é è\nx " + "y" * 300 + " z", " q", "end", "same same"], pa.string())
    h, bounds = text.words(rows)
    assert (bounds[1:] - bounds[:-1]).tolist() == [4, 0, 0, 5, 1, 1, 2]
    assert h[-1] == h[-2] and len(set(h.tolist())) == len(h) - 1
    for size in (1, 7, 64):
        monkeypatch.setattr(text, "SLICE", size)
        again, cuts = text.words(rows)
        assert (again == h).all() and (cuts == bounds).all()


def test_shingles_are_sets_of_runs():
    rows = ["a b c d e f a b c d e f", "a b", "", "a b c d e"]
    h, bounds = text.words(pa.array(rows))
    found, ends = text.shingles(h, bounds, 5)
    sizes = (ends[1:] - ends[:-1]).tolist()
    words = [r.split() for r in rows]
    want = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert sizes == [len(s) for s in want]
    first = set(found[ends[0] : ends[1]].tolist())
    assert set(found[ends[3] : ends[4]].tolist()) <= first
