import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lacuna.llm import merkle
from lacuna.llm.storage import new_path

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc, source, lang, n, text):
    return h("".join(map(field, (doc, source, lang, n, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by_lang[g], key=lambda x: x[:3])]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for pos, (_, _, own, r) in enumerate(sorted(by_lang[g], key=lambda x: x[:3])):
            proof, doc = [], r[0]
            claim = leaf(doc, r[1], r[2], r[3] + 1, r[4]) if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and r[3] is not None else own
            for tree, p in ((trees[g], pos), (top, j)):
                for nodes in tree[:-1]:
                    run = nodes[p // 2 * 2 : p // 2 * 2 + 2]
                    proof += [x for k, x in enumerate(run) if k != p % 2]
                    run[p % 2] = claim
                    claim, p = h("".join(run)), p // 2
            out.append((doc, own, trees[g][-1][0], top[-1][0], h("".join(proof)), claim, claim == top[-1][0]))
    return out


def rows_of(n=700):
    rows = [(k, f"s{k % 3}", "en", k, "text é " * (k % 5)) for k in range(n)]
    rows += [(k, None, "de", None, None) for k in range(0, 40)] + [(7, "x", None, 3, ""), (8, "x", "", 3, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    rows += [(None, "x", "fr", 3, "a"), (None, "x", "fr", 3, "a"), (None, "y", "fr", None, "b"), (5, "x", "fr", 1, "c"), (5, "x", "fr", 1, "c"), (5, "x", "fr", 2, "c"), (-3, "x", "fr", 2, "z" * 200_000), (1, "", "Zz", 0, "lone")]
    return rows


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op11_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("tier", [8, 2])
def test_against_brute_force(spark, tmp_path, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    rows = rows_of(700 if tier == 8 else 150)
    got, want = run(spark, tmp_path, rows), brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 2, "x")], [(1, "a", None, 2, "x"), (2, "a", "b", 2, "y")]])
def test_small_tables(spark, tmp_path, rows):
    assert sorted(run(spark, tmp_path, rows)) == sorted(brute(rows))


def test_manifest_can_be_opened_and_asked_by_coordinate(spark):
    rows = spark.createDataFrame(rows_of(300), SCHEMA).withColumns({"path": F.lit(1), "note": F.col("doc_id") * 2})
    path = new_path(spark, "merkle-test")
    merkle.build(rows.select("lang", "doc_id", merkle.document_leaf().alias("leaf"), "note"), path, ("note",))
    held = merkle.Manifest.open(spark, path)
    whole = {(r["lang"], r["position"]): r for r in held.proofs().collect()}
    assert len(whole) == rows.count()
    wanted = spark.createDataFrame([("en", 0), ("en", 299), ("en", 299), ("fr", 3), (None, 0), ("xx", 0), ("en", 5000)], "lang string, position long")
    found = {(r["lang"], r["position"]): r for r in held.proofs(wanted).collect()}
    assert set(found) == {("en", 0), ("en", 299), ("fr", 3), (None, 0)}
    for k, r in found.items():
        assert r == whole[k]
    assert found["en", 299]["note"] == 598 and found["en", 299]["doc_id"] == 299
    folded = held.proofs(wanted).select(merkle.fold(F.col("leaf"), F.col("path")).alias("h"), "root").collect()
    assert all(r["h"] == r["root"] for r in folded)
    roots = {r["lang"]: r for r in held.roots().collect()}
    assert roots["en"]["leaves"] == 300 and set(roots) == {"en", "de", "fr", None, "", "Zz"}
    with pytest.raises(ValueError):
        merkle.build(rows, path + "x", ("path",))
