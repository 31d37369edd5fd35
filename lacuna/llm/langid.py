"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language excerpts of training texts are put together to a zstandard raw-content dictionary. A text
is encoded with each of them, and the smallest sum of sizes wins; the score is the share of the winner in
``2 ** (-bytes / NARROW)`` over all languages, so it is 1 where all others are far behind and 1 / n where n
languages tie. Below ``min_score`` the margin is too narrow and :func:`identify` rejects the text, which then
is of no language (``und``); ``nearest`` still names the smallest. Ties go to the language with more
training texts, then by name.

Texts are lower-cased and runs of anything but letters are one space, so that neither capitals nor markup
count. Whole texts are encoded, in chunks of ``CHUNK`` bytes, since behind more a dictionary is out of
sight; sizes are summed. Dictionaries are bounded: ``DICT_BYTES`` a language and ``ALL_BYTES`` in total, made of
excerpts of ``EXCERPT`` characters from hashed places of the texts of least hash; texts are thinned by that hash before a
language's are ranked. That bounds what the driver collects and tasks rank or are sent, whatever the number of texts or languages.

A text that is null or has no letter is ``und`` with score 0; so are all where nothing can be learned.
Languages are learned from rows with a text, a lang and a doc_id that isn't held out (crc32 of the doc_id as
text, modulo 3, isn't 1). A row with a null doc_id is neither learned from nor held out. Repeated rows are
learned once and predicted alike. Only named columns are read; columns of the input with an output's name
are replaced, and names that begin with two underscores are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fits_broadcast, lean, materialize, refuse_own_names, release

#: Bounds of what is learned: bytes of a dictionary and of all, characters of an excerpt.
DICT_BYTES, ALL_BYTES, EXCERPT = 128 << 10, 32 << 20, 768
CHUNK, LEVEL = 4096, 6
#: Bytes by which a language has to be larger to count half.
NARROW = 1.5
MIN_SCORE = 0.6
HELD_OUT, FOLDS = 1, 3
UNKNOWN = "und"
#: Characters normalised together.
SEGMENT = 1 << 16
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


@dataclass(frozen=True)
class Model:
    """Languages in the order in which they win ties, and their dictionaries."""

    langs: tuple[str, ...]
    contents: tuple[bytes, ...]

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for content in self.contents:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=options)
            out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=options))
        return out


def sizes(text: str, encoders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text with each dictionary."""
    total = [0] * len(encoders)
    for at in range(0, len(text), SEGMENT):
        data = normalised(text[at : at + SEGMENT]).encode("utf-8", "replace")
        for k in range(0, len(data), CHUNK):
            for j, encoder in enumerate(encoders):
                total[j] += len(encoder.compress(data[k : k + CHUNK]))
    return total


def nearest(text: str | None, model: Model, encoders: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
    if not text or not model.langs or not _LETTER.search(text):
        return UNKNOWN, 0.0
    found = sizes(text, encoders)
    best = min(found)
    return model.langs[found.index(best)], 1 / sum(2.0 ** max(-(x - best) / NARROW, -1000) for x in found)


def learn(docs: DataFrame) -> Model:
    """Dictionaries of the languages of ``docs`` (doc_id, text, lang)."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where((fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("text")
    place = F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    rows = materialize(known.where(F.col("text").rlike(r"\p{L}")).select("lang", order.alias("h"), F.call_function("substring", F.col("text"), place, F.lit(EXCERPT)).alias("excerpt")).groupBy("lang", "h").agg(F.min("excerpt").alias("excerpt"), F.count("*").alias("n")), "langid-excerpts")
    counts = materialize(rows.groupBy("lang").agg(F.sum("n").alias("texts"), F.count("*").alias("distinct")), "langid-counts")
    texts = {r["lang"]: r["texts"] for r in counts.collect()}  # a row a language
    if not texts:
        return Model((), ())
    size = min(DICT_BYTES, ALL_BYTES // len(texts))
    count = math.ceil(2 * size / EXCERPT)  # short texts are shorter
    share = F.least(F.lit(1.0), (2.0 * count + 100) / F.col("distinct"))  # so about twice as many are ranked, whatever the number of texts
    side = counts.select("lang", "distinct")
    some = rows.join(F.broadcast(side) if fits_broadcast(len(texts), 64) else side, "lang").where(F.col("h").cast("double") <= -(2.0**63) + share * 2.0**64)
    first = Window.partitionBy("lang").orderBy("h")
    held: dict[str, list[str]] = {}
    for r in some.withColumn("at", F.row_number().over(first)).where(F.col("at") <= count).orderBy("lang", "at").collect():
        held.setdefault(r["lang"], []).append(r["excerpt"])
    release(rows, counts)
    langs = sorted(held, key=lambda lang: (-texts[lang], lang))
    return Model(tuple(langs), tuple(_content(held[lang], size) for lang in langs))


def _content(excerpts: list[str], size: int) -> bytes:
    out, held = [], 0
    for text in excerpts:
        data = normalised(text).encode("utf-8", "replace") + b" "
        out.append(data)
        held += len(data)
        if held >= size:
            break
    return b"".join(out)[:size]


def identify(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` (text) with ``nearest``, ``score`` and ``lang_pred``: the nearest language, ``und`` where its margin is too narrow."""
    refuse_own_names(docs)
    columns = [c for c in docs.columns if c not in ("nearest", "score", "lang_pred")]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"))
    schema = kept.drop("__text").schema.add("nearest", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = model.encoders()
        for batch in batches:
            found = [nearest(text.as_py(), model, encoders) for text in batch.column("__text")]
            own = [batch.column(c) for c in columns]
            yield pa.record_batch([*own, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*columns, "nearest", "score"])

    out = kept.mapInArrow(lean(run), schema)
    return out.withColumn("lang_pred", F.when(F.col("score") >= min_score, F.col("nearest")).otherwise(UNKNOWN))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs)
    rows = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", F.col("nearest").alias("lang_pred"), "score")
