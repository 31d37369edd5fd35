import random
import zlib

import pytest
from pyspark.sql import functions as F

from lacuna.llm import langid

SYLLABLES = {"aa": "the ing and er on at ed th re", "bb": "der ein sch ich ung ber zu ß ü", "cc": "ción que el los ado ñ la en"}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def rows_of(n=400, seed=3):
    rng = random.Random(seed)
    return [(k, text(rng, lang := rng.choice(["aa", "aa", "bb", "cc"]), rng.randrange(3, 200)), lang) for k in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(spark.createDataFrame(rows_of(), "doc_id long, text string, lang string"))


def test_held_out_accuracy_and_columns(spark, tmp_path):
    rows = rows_of() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 -- !!", "aa"), (1003, "the and", None), (None, "der ein ich", "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = langid.op13_language_id(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for doc, t, _ in rows:
        r = got[doc]
        assert r["held_out"] == (doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))
    held = [(d, lang) for d, t, lang in rows if lang and got[d]["held_out"] and d < 1000]
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.98 * len(held)
    assert sorted(out.collect(), key=str) == sorted(langid.op13_language_id(spark, str(tmp_path)).collect(), key=str)


def test_learns_only_from_what_it_may(spark, model):
    rows = rows_of()
    spoiled = [(d, t, lang if zlib.crc32(str(d).encode()) % 3 != 1 else "zz") for d, t, lang in rows] + [(None, "xyz " * 50, "qq"), (2000, "abc", None), (2001, None, "rr"), (2002, "123", "ss")]
    again = langid.learn(spark.createDataFrame(spoiled, "doc_id long, text string, lang string"))
    assert again == model and set(model.langs) == {"aa", "bb", "cc"} and model.langs[0] == "aa"


def test_bounds_of_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_BYTES", 3000)
    found = langid.learn(spark.createDataFrame(rows_of(), "doc_id long, text string, lang string"))
    assert all(len(c) <= 1000 for c in found.contents) and len(found.langs) == 3


def test_whole_texts_count(model):
    """What decides lies behind a long beginning."""
    rng = random.Random(5)
    encoders = model.encoders()
    long = text(rng, "bb", 40) + " " + text(rng, "cc", 30_000)
    assert langid.nearest(long, model, encoders)[0] == "cc"
    assert langid.nearest("1" * 300_000 + " " + text(rng, "bb", 60), model, encoders)[0] == "bb"
    assert langid.nearest(text(rng, "aa", 50).upper() + "!!!", model, encoders)[0] == "aa"


def test_sizes_against_plain_encoding(model):
    import zstandard

    t = text(random.Random(6), "aa", 100)
    for content, encoder in zip(model.contents, model.encoders()):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed = encoder.compress(langid.normalised(t).encode())
        back = zstandard.ZstdDecompressor(dict_data=data, format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(packed, max_output_size=1 << 20)
        assert back.decode() == langid.normalised(t)
        assert langid.sizes(t, [encoder]) == [len(packed)]


def test_narrow_margins_are_rejected(spark, model):
    df = spark.createDataFrame([(1, text(random.Random(7), "bb", 80)), (2, "x"), (2, "x"), (3, None)], "doc_id long, text string").withColumns({"score": F.lit("mine"), "nearest": F.lit(1), "other col": F.lit(4)})
    rows = langid.identify(df, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 4 and got[1]["other col"] == 4
    assert got[1]["lang_pred"] == "bb" and got[1]["score"] > 0.9
    assert got[2]["lang_pred"] == "und" and got[2]["nearest"] in model.langs and got[2]["score"] < 0.6
    assert got[3]["lang_pred"] == got[3]["nearest"] == "und" and got[3]["score"] == 0
    with pytest.raises(ValueError):
        langid.identify(df.withColumn("__text", F.lit(1)), model)


def test_empty_and_unlearnable(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    empty = langid.learn(none)
    assert empty == langid.Model((), ())
    assert langid.identify(none, empty).collect() == []
    some = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert langid.identify(some, langid.learn(some)).first()["lang_pred"] == "und"
