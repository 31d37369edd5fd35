"""Boundaries and removed lines are computed here from plain Python, without the module's code."""

import random
from collections import defaultdict

import pytest
import xxhash

from lacuna.llm import linedup

PASSAGE = ["alpha beta gamma %d" % k for k in range(12)]
SCHEMA = "doc_id long, text string"


def signed(data: bytes) -> int:
    h = xxhash.xxh64(data, seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def n_words(text):
    return len([w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w])


def chunks(lines):
    """(first, last) by the rules of the docstring."""
    h = [signed(x.encode()) for x in lines]
    long = [n_words(x) >= 50 for x in lines]
    out, first = [], 0
    for k, x in enumerate(lines):
        after = lines[k + 1] if k + 1 < len(lines) else None
        end = after is None or long[k] or long[k + 1]
        if not end and after != x:
            end = k > 0 and lines[k - 1] == x or k > 0 and h[k] < h[k - 1] and h[k] < h[k + 1] or k + 2 < len(lines) and after == lines[k + 2]
        if end:
            out.append((first, k))
            first = k + 1
    return out, long


def brute(rows):
    """Kept texts by (doc_id, text)."""
    docs = sorted({(doc, text) for doc, text in rows if text is not None}, key=lambda d: (d[0] is None, d[0] or 0, signed(d[1].encode())))
    first, split, gone, whole = {}, {}, defaultdict(set), defaultdict(list)
    for doc in docs:
        split[doc] = doc[1].split("\n")
        _, long = chunks(split[doc])
        lines = split[doc]
        for k in range(len(lines)):
            if k + 1 < len(lines) and lines[k] + lines[k + 1]:
                first.setdefault((lines[k], lines[k + 1]), (doc, k))
            if long[k]:
                first.setdefault((lines[k],), (doc, k))
    for doc in docs:  # whole chunks by their lines
        for j, (a, b) in enumerate(chunks(split[doc])[0]):
            if b > a and any(split[doc][a : b + 1]):
                whole[tuple(split[doc][a : b + 1])].append((doc, j))
    for places in whole.values():
        of, i = places[0]
        there = chunks(split[of])[0]
        for doc, j in places[1:]:
            own = chunks(split[doc])[0]
            a, b = own[j]
            gone[doc].update(range(a, b + 1))
            if doc != of:
                near = lambda d, c, k: split[d][c[k][0] : c[k][1] + 1] if 0 <= k < len(c) else []
                for side, step in ((reversed, -1), (list, 1)):
                    at = a if step < 0 else b
                    for x, y in zip(side(near(doc, own, j + step)), side(near(of, there, i + step))):
                        if x != y:
                            break
                        at += step
                        gone[doc].add(at)
    for doc in docs:
        lines = split[doc]
        own, long = chunks(lines)
        aligned = defaultdict(list)
        for k in range(len(lines)):
            for piece in ([(lines[k], lines[k + 1])] if k + 1 < len(lines) and lines[k] + lines[k + 1] else []) + ([(lines[k],)] if long[k] else []):
                of, at = first[piece]
                if (of, at) != (doc, k):
                    aligned[of, k - at, len(piece)].append(k)
        for (of, shift, n), at in aligned.items():
            at.sort()
            while at:
                m = 1
                while m < len(at) and at[m] == at[0] + m:
                    m += 1
                a, b = at[0], at[m - 1] + n - 1
                at = at[m:]
                if of == doc and shift < b - a + 1:
                    continue
                if n == 1 or any(x >= a and y <= b and y > x for x, y in own) or n_words("\n".join(lines[a : b + 1])) >= 50:
                    gone[doc].update(range(a, b + 1))
    return {doc: "\n".join(x for k, x in enumerate(split[doc]) if k not in gone[doc]) for doc in docs}


def kept(df):
    return {(r["doc_id"], r["old"]): r["text"] for r in df.collect()}


def check(got, rows):
    want = brute(rows)
    for (doc, old), text in got.items():
        assert text == (None if old is None else want[doc, old]), (doc, (old or "")[:60])


def test_boundaries(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["", "a", "b", "c d", "e", "w " * 55, "x" * 200]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    found = linedup.with_chunks(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in found:
        own, long = chunks(r["text"].split("\n"))
        assert [(c["first"], c["last"]) for c in r["__chunks"]] == own
        assert [c["long"] for c in r["__chunks"]] == [long[b] for _, b in own]


def test_matches_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(k, "\n".join([f"own line {k} {j}" for j in range(k % 4)] + PASSAGE + [f"end {k} {j}" for j in range(k % 3)])) for k in range(9)]
    rows += [(20, "one\n" + long + "\ntwo"), (21, long), (22, "x\n" + long), (23, None), (24, ""), (None, "\n".join(PASSAGE)), (25, "same\nlines"), (26, "only"), (27, "only")]
    rows += [(30, "\n".join(PASSAGE * 3)), (31, "a\n" * 4000), (32, "\n\n\n"), (33, "p\n\n\nq"), (34, "r\n\n\ns")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS old", "1 AS n_lines", "2 AS hash", "3 AS first", "4 AS lines", "5 AS at", "6 AS bytes")
    got = kept(linedup.dedupe(df))
    assert len(got) == len(rows)
    check(got, rows)
    # the passage goes from all but one document, however lines before it shift it
    middle = PASSAGE[4:8]
    assert sum(all(m in t for m in middle) for (d, o), t in got.items() if t and d is not None and d < 9) == 1
    assert sum(long in t for t in got.values() if t) == 1
    assert got[27, "only"] == "only"  # single short lines stay
    assert got[34, "r\n\n\ns"] == "r\n\n\ns"  # empty lines, too


def test_random_texts_match_brute_force(spark):
    rng = random.Random(2)
    line = [" ".join(f"v{rng.randrange(99)}" for _ in range(rng.choice([1, 4, 20, 55]))) for _ in range(60)]
    parts = [[rng.choice(line) for _ in range(rng.randrange(1, 9))] for _ in range(25)]
    rows = [(k, "\n".join(x for _ in range(rng.randrange(1, 5)) for x in (rng.choice(parts) if rng.random() < 0.6 else [f"own {k} {rng.random()}"]))) for k in range(150)]
    rows += rows[:5] + [(7, rows[9][1]), (None, rows[3][1])]
    check(kept(linedup.dedupe(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS old"))), rows)


@pytest.mark.parametrize("words, least", [(4, 0.99), (30, 0.999)])
def test_recall_of_passages(spark, words, least):
    """Second copies of 12-line passages of a few words a line, or of 2 to 8 lines of 60 words and more in all, go wholly."""
    rng, rows, held = random.Random(3), [], {}
    for p in range(200):
        n = 12 if words == 4 else 2 + p % 7
        held[p] = [" ".join(f"p{p}l{k}w{j}" for j in range(words)) for k in range(n)]
        for d in (2 * p, 2 * p + 1):
            rows.append((d, "\n".join([f"own {d} before {k}" for k in range(rng.randrange(4))] + held[p] + [f"own {d} after {k}" for k in range(rng.randrange(3))])))
    got = {r["doc_id"]: r for r in linedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = dict(rows)
    assert all(got[2 * p]["text"] == texts[2 * p] for p in held)
    whole = sum(got[2 * p + 1]["text"] == "\n".join(x for x in texts[2 * p + 1].split("\n") if x not in held[p]) for p in held)
    assert whole >= least * len(held)


def test_an_unrelated_document_doesnt_keep_a_chunk(spark):
    """A first document that shares only two lines of a chunk leaves its later occurrences where they are: they go."""
    rng, tried = random.Random(8), 0
    while tried < 5:
        chunk = [f"line {rng.random()}" for _ in range(5)]
        rows = [(2, "\n".join(["a", "b", *chunk, "c", "d"])), (3, "\n".join(["e", *chunk, "f"])), (4, "\n".join(["g", "h", *chunk, "i"]))]
        inside = [set((tuple(t.split("\n")[a : b + 1]) for a, b in chunks(t.split("\n"))[0] if b > a)) for _, t in rows]
        if not (shared := {c for c in set.intersection(*inside) if len(c) > 2}):
            continue
        tried += 1
        rows.append((1, "\n".join(["x", *max(shared, key=len)[:2], "y"])))
        got = {r["doc_id"]: r["text"] for r in linedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()}
        for c in shared:
            assert "\n".join(c) in got[2] and all("\n".join(c) not in got[d] for d in (3, 4))
        assert got == {d: t for (d, _), t in brute(rows).items()}


def test_every_later_chunk_goes(spark):
    """On the given table no occurrence of a byte-equal chunk of several lines stays but the first."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    gone = {(r["__doc"], r["__text"]): {k for g in r["__gone"] for k in range(g["first"], g["first"] + g["lines"])} for r in linedup.removed_lines(docs).collect()}
    places = defaultdict(list)
    for doc, text in sorted({tuple(r) for r in docs.collect()}, key=lambda d: (d[0], signed(d[1].encode()))):
        lines = text.split("\n")
        for a, b in chunks(lines)[0]:
            if b > a and any(lines[a : b + 1]):
                places["\n".join(lines[a : b + 1])].append((doc, signed(text.encode()), a, b))
    later = [x for own in places.values() for x in own[1:]]
    assert later and all(set(range(a, b + 1)) <= gone[doc, t] for doc, t, a, b in later)
    for own in places.values():  # and of each text one copy of every line is kept
        assert own[0][3] >= own[0][2]


def test_one_line_repeated(spark):
    rows = [(1, "x\n" + "again and again\n" * 200 + "y"), (2, "z\n" + "again and again\n" * 200 + "w"), (3, "again and again\n" * 150)]
    got = {r["doc_id"]: r["text"] for r in linedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == rows[0][1]
    assert got == {d: brute(rows)[d, t] for d, t in rows}


def test_repeated_rows_lose_the_same(spark):
    rows = [(1, "\n".join(PASSAGE)), (1, "\n".join(PASSAGE)), (2, "\n".join(PASSAGE))]
    out = linedup.dedupe(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 0, 12]


def test_whole_table(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = {d: hashlib.sha256(t.encode()).hexdigest() for (d, _), t in brute(rows).items()}
    got = {r["doc_id"]: r["kept_sha256"] for r in linedup.op6_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want | {d: None for d, t in rows if t is None}


def test_empty(spark):
    assert linedup.dedupe(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_names_are_refused(spark):
    with pytest.raises(ValueError, match="__lines"):
        linedup.dedupe(spark.createDataFrame([(1, "a", 2)], SCHEMA + ", __lines int"))
