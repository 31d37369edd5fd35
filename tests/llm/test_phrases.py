import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import phrases


def brute(rows, max_words=3, least=10, absorb=50, top=2000):
    f, n = {}, Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        counts = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(words)
            for k in range(1, max_words + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), a)
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) >= absorb * a and p in inside:
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (score, _, p, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed=1, n=400):
    rng = random.Random(seed)
    common, rare = ["the", "The", "of", "a", "é", "Éa", " x", "b\x01", "a\x01", "\U0001f600"], [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        words = [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "! "] if rng.random() < 0.4 else [" "]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", "", "a\tb"]), text))
    rows += [("en", None), ("en", ""), (None, ".. ,\n"), ("xx", "lonely"), ("en", "the the the the " * 500), ("hot", "q r s " * 3000), ("hot", "q\tr s;" * 20)]
    return rows + [("copy", "one two three four.")] * 30


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({"head": F.lit(1), "n": F.lit(2), "phrase": F.lit(3)})
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("hot", [1000, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    rows = texts()
    assert run(spark, rows) == brute(rows)


def test_longer_phrases_and_few_best(spark):
    rows = texts(2, 150)
    assert run(spark, rows, max_words=5, min_count=3, absorb_percent=80, top=7) == brute(rows, 5, 3, 80, 7)


def test_without_sending_the_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "fits_broadcast", lambda *a: False)
    rows = texts(3, 120)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None)]) == []


def test_kernels_over_small_buffers_and_batches(monkeypatch):
    """Slices, buffers and batches may end anywhere between pieces and projections."""
    rows = texts(4, 200)
    monkeypatch.setattr("lacuna.llm.text.SLICE", 100)
    monkeypatch.setattr(phrases, "FLUSH", 50)
    batch = pa.record_batch([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    made = pa.Table.from_batches(phrases._project(None, 3)(iter(batch.slice(k, 9) for k in range(0, len(batch), 9))))
    assert len(made) > len(made.group_by(["head", "tail"]).aggregate([]))
    ordered = made.sort_by([("head", "ascending"), ("tail", "ascending")])
    want = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (2, 3):
                want.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    want = {k: n for k, n in want.items() if n >= 10}
    for size in (1, 7, 100_000):
        got = pa.Table.from_batches(phrases._grow(3, 10)(iter(ordered.to_batches(max_chunksize=size)))).to_pylist()
        assert len(got) == len(want)
        assert {(r["lang"], r["phrase"]): r["n"] for r in got} == want


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 2, 3_000_000_000)], "lang string, phrase string, words int, n long")
    words = spark.createDataFrame([("en", "a", 5_000_000_000), ("en", "b", 7_000_000_001)], "lang string, phrase string, n long")
    r = phrases.scored(found, words).first()
    assert r["score"] == 10**6 * 3_000_000_000**2 // (5_000_000_000 * 7_000_000_001)


def test_memory_of_a_task_does_not_follow_its_words():
    import tracemalloc

    import numpy as np

    names = np.array([f"w{k}" for k in range(3000)])
    rng = np.random.default_rng(1)
    texts = [" ".join(names[rng.integers(3000, size=20_000)]) for _ in range(80)]
    batches = [pa.record_batch([pa.array(["en"] * 4), pa.array(texts[k : k + 4])], ["lang", "text"]) for k in range(0, 80, 4)]
    tracemalloc.start()  # sees NumPy's arrays, of 150 MB before buffers were smaller
    rows = sum(len(b) for b in phrases._project(None, 3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1_500_000 and peak < 90 << 20
