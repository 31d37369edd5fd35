"""Line deduplication by content-defined chunks, with DataFrame functions alone.

A text's lines are hashed, and a window of three line hashes rolls over them: a chunk ends after a line
whose hash is the least of its window. So a chunk between two such lines has two lines or more, three on
average, its ends depend on the lines around them and not on their place, and a passage inserted into
other documents is cut alike inside. A line that is repeated in a row makes a chunk with its repeats, and
a line of ``LONG_WORDS`` words or more is a chunk of its own.

Chunks of two lines or more, and long lines, are compared by their digests: one that repeats is removed
wherever it stands but for its first place, by (doc_id, digest of the text, line), whatever else its lines
occur in, once its bytes were compared with those of the first place. The removal is extended to equal
lines of the chunks before and behind, compared by bytes, too, where the first place is in another document.

Passages may be too short to hold a whole chunk. So pairs of lines that repeat are aligned with their first
places, as well: pairs in a row that stand in a row at their first places make a run, which is removed if it
holds a whole chunk or ``PASSAGE_WORDS`` words. This only adds to what chunks remove. Every removed line has an
equal one at a lesser place, so one copy stays. Lines that repeat one by one, empty chunks, and runs that
overlap their own first place stay.

Only hashes are exchanged to find what repeats: they are counted first, and joined with those that repeat
from written tables, so that a hot one is broadcast to or split. Texts move only of documents that hold
runs or first places of runs; the documents themselves are joined with the removed places, which are
broadcast as long as their counted number allows it. Groups of equal pairs are never gathered.

Lines end at a newline. A null text stays null and has no lines; an empty text is one empty line. Rows
that share doc_id and text count as one document and lose the same lines; a null doc_id is an id of its
own, after others. An empty table gives an empty table; further columns are kept (names that begin with
two underscores are this module's and refused).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fits_broadcast, materialize, refuse_own_names, release

LONG_WORDS = PASSAGE_WORDS = 50
_WORD = "[^\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    """Whether ``text`` has PASSAGE_WORDS words; counted only where its length allows it."""
    return F.when(F.length(text) < 2 * PASSAGE_WORDS - 1, F.lit(False)).otherwise(F.regexp_count(text, F.lit(_WORD)) >= PASSAGE_WORDS)


def with_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with __lines, __marks (h, chars, long of each line) and __chunks, array(struct(first, last, long)) by places of lines.

    Each step is a column of its own, so that what a lambda looks at isn't computed anew for each line."""
    line = F.transform("__lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("chars"), _words(x).alias("long")))
    marked = docs.withColumn("__lines", F.split("text", "\n")).withColumn("__marks", line)
    at = lambda k: F.get("__marks", k)

    def ends(x: Column, k: Column) -> Column:
        before, after = at(k - 1), at(k + 1)
        same = F.coalesce(before["h"] == x["h"], F.lit(False))
        rolled = F.coalesce((x["h"] < before["h"]) & (x["h"] < after["h"]), F.lit(False))
        return x["long"] | (k + 1 == F.size("__marks")) | F.coalesce(after["long"], F.lit(False)) | F.when(after["h"] == x["h"], F.lit(False)).otherwise(same | rolled | F.coalesce(after["h"] == at(k + 2)["h"], F.lit(False)))

    last = marked.withColumn("__flags", F.transform("__marks", lambda x, k: F.struct(k.alias("at"), x["long"].alias("long"), ends(x, k).alias("ends")))).withColumn("__ends", F.filter("__flags", lambda e: e["ends"]))
    found = last.withColumn("__chunks", F.transform("__ends", lambda e, n: F.struct((F.coalesce(F.get("__ends", n - 1)["at"], F.lit(-1)) + 1).alias("first"), e["at"].alias("last"), e["long"].alias("long"))))
    return found.drop("__flags", "__ends")


def _pieces(docs: DataFrame) -> DataFrame:
    """(__doc, __text, at, lines, block, hash, chars, chunk): chunks of two lines or more (block), pairs of lines and long lines; chunk: the last line of a chunk of two or more that begins at ``at``."""
    keyed = with_chunks(docs)
    ends = F.flatten(F.transform("__chunks", lambda c: F.concat(F.array(F.when(c["last"] > c["first"], c["last"])), F.array_repeat(F.lit(None).cast("int"), c["last"] - c["first"]))))
    keyed = keyed.withColumn("__begun", ends)
    mark = lambda k: F.get("__marks", k)
    pair = lambda x, k: F.when(x["chars"] + mark(k + 1)["chars"] > 0, F.struct(k.alias("at"), F.lit(2).alias("lines"), F.lit(False).alias("block"), F.xxhash64(x["h"], mark(k + 1)["h"]).alias("hash"), (x["chars"] + mark(k + 1)["chars"]).alias("chars"), F.get("__begun", k).alias("chunk")))
    alone = lambda x, k: F.when(x["long"], F.struct(k.alias("at"), F.lit(1).alias("lines"), F.lit(False).alias("block"), F.xxhash64(x["h"]).alias("hash"), x["chars"].alias("chars"), k.alias("chunk")))
    longs = F.when(F.exists("__marks", lambda x: x["long"]), F.array_compact(F.transform("__marks", alone))).otherwise(F.array().cast("array<struct<at:int,lines:int,block:boolean,hash:bigint,chars:int,chunk:int>>"))
    own = lambda c: F.slice(F.col("__marks"), c["first"] + 1, c["last"] - c["first"] + 1)
    chars = lambda c: F.aggregate(own(c), F.lit(0), lambda n, x: n + x["chars"])
    block = lambda c: F.when((c["last"] > c["first"]) & (chars(c) > 0), F.struct(c["first"].alias("at"), (c["last"] - c["first"] + 1).alias("lines"), F.lit(True).alias("block"), F.xxhash64(F.lit("chunk"), F.transform(own(c), lambda x: x["h"])).alias("hash"), chars(c).alias("chars"), c["last"].alias("chunk")))
    both = F.concat(F.array_compact(F.transform("__chunks", block)), F.array_compact(F.transform(F.slice("__marks", 1, F.size("__marks") - 1), pair)), longs)
    return keyed.select("__doc", "__text", F.explode(both).alias("c")).select("__doc", "__text", "c.*")


def _runs(docs: DataFrame) -> DataFrame:
    """Repeated chunks, and runs of other repeated pieces, with their first places: (__doc, __text, first, lines, block, whole, of_doc, of_text, of_first); written."""
    table = materialize(_pieces(docs), "line-pieces")
    repeated = materialize(table.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "line-repeated")
    held = materialize(table.join(F.broadcast(repeated) if fits_broadcast(repeated.count(), 32) else repeated, "hash"), "line-held")
    release(table, repeated)
    place = F.struct(F.col("__doc").isNull().alias("none"), F.col("__doc").alias("doc"), F.col("__text").alias("text"), F.col("at").alias("at"))
    first = materialize(held.groupBy("hash").agg(F.min(place).alias("of")), "line-first")
    met = held.join(F.broadcast(first) if fits_broadcast(first.count(), 96) else first, "hash")
    own = F.col("__doc").eqNullSafe(F.col("of.doc")) & (F.col("__text") == F.col("of.text"))
    again = met.where(~own | (F.col("at") != F.col("of.at"))).select("__doc", "__text", "at", "lines", "block", "chars", "chunk", F.col("of.doc").alias("of_doc"), F.col("of.text").alias("of_text"), (F.col("at") - F.col("of.at")).alias("shift"))
    by = ("__doc", "__text", "block", "lines", "of_doc", "of_text", "shift")  # a document's rows stay where they are
    in_row = F.col("at") - F.dense_rank().over(Window.partitionBy(*by).orderBy("at"))
    island = again.repartition("__doc", "__text").withColumn("island", F.when(F.col("block"), F.col("at")).otherwise(in_row))  # a chunk is a run of its own
    whole = F.coalesce(F.min("chunk") <= F.max("at") + F.col("lines") - 1, F.lit(False))
    runs = island.groupBy(*by, "island").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + F.col("lines")).alias("n"), whole.alias("whole"), F.sum("chars").alias("chars"))
    apart = ~(F.col("__doc").eqNullSafe(F.col("of_doc")) & (F.col("__text") == F.col("of_text"))) | (F.col("shift") >= F.col("n"))
    kept = runs.where(apart & (F.col("whole") | (F.col("chars") >= 2 * PASSAGE_WORDS - 1)))
    out = materialize(kept.select("__doc", "__text", "first", F.col("n").alias("lines"), "block", "whole", "of_doc", "of_text", (F.col("first") - F.col("shift")).alias("of_first")), "line-runs")
    release(held, first)
    return out


def _equal(a: Column, b: Column) -> Column:
    """How many lines are equal from the beginning on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def removed_lines(docs: DataFrame) -> DataFrame:
    """__doc, __text (its digest) and __gone: array(struct(first, lines)) of runs to remove; only documents that lose some; written."""
    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__text"), "text")
    runs = _runs(keyed)
    ends = runs.select("__doc", "__text", "first", "lines", "block").unionByName(runs.select(F.col("of_doc").alias("__doc"), F.col("of_text").alias("__text"), F.col("of_first").alias("first"), "lines", "block"))
    wanted = ends.groupBy(F.col("__doc").alias("__d"), F.col("__text").alias("__t")).agg(F.collect_set(F.struct("first", "lines", "block")).alias("__held"))  # a document's own places
    wanted = F.broadcast(wanted) if fits_broadcast(runs.count(), 96) else wanted
    met = with_chunks(keyed.join(wanted, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t"))))
    lines = lambda first, n: F.slice(F.col("__lines"), first + 1, n)
    beside = lambda c, chunk: F.when(c["block"], F.get(F.filter("__chunks", chunk), F.lit(0)))
    span = lambda x: F.coalesce(lines(x["first"], x["last"] - x["first"] + 1), F.array().cast("array<string>"))
    piece = lambda c: F.struct(c["first"].alias("first"), c["lines"].alias("lines"), c["block"].alias("block"), F.array_join(lines(c["first"], c["lines"]), "\n").alias("bytes"), F.reverse(span(beside(c, lambda x: x["last"] == c["first"] - 1))).alias("before"), span(beside(c, lambda x: x["first"] == c["first"] + c["lines"])).alias("behind"))
    texts = materialize(met.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.explode(F.transform("__held", piece)).alias("c")).select("d", "t", "c.*").distinct(), "line-texts")
    side = lambda doc, text, first, name: (F.col(doc).eqNullSafe(F.col(f"{name}.d")) & (F.col(text) == F.col(f"{name}.t")) & (F.col(first) == F.col(f"{name}.first")) & (F.col("r.lines") == F.col(f"{name}.lines")) & (F.col("r.block") == F.col(f"{name}.block")))
    both = runs.alias("r").join(texts.alias("own"), side("r.__doc", "r.__text", "r.first", "own")).join(texts.alias("of"), side("r.of_doc", "r.of_text", "r.of_first", "of"))
    equal = both.where((F.col("own.bytes") == F.col("of.bytes")) & (F.col("r.whole") | _words(F.col("own.bytes"))))
    apart = F.col("r.block") & ~(F.col("r.__doc").eqNullSafe(F.col("r.of_doc")) & (F.col("r.__text") == F.col("r.of_text")))
    before, behind = (F.when(apart, _equal(F.col(f"own.{c}"), F.col(f"of.{c}"))).otherwise(0) for c in ("before", "behind"))
    gone = equal.select("r.__doc", "r.__text", (F.col("r.first") - before).alias("first"), (F.col("r.lines") + before + behind).alias("lines"))
    gone = gone.groupBy("__doc", "__text").agg(F.sort_array(F.collect_set(F.struct("first", "lines"))).alias("__gone"))
    gone = materialize(gone, "line-gone")
    release(runs, texts)
    return gone


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with their kept text, and the numbers of lines and removed lines (``n_lines``, ``n_removed``)."""
    refuse_own_names(docs)
    gone = removed_lines(docs)
    small = gone.select(F.count("*").alias("n"), F.coalesce(F.sum(F.size("__gone")), F.lit(0)).alias("c")).first()
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    right = gone.withColumnsRenamed({"__doc": "__d", "__text": "__t"})
    right = F.broadcast(right) if fits_broadcast(small["n"] * 4 + small["c"], 16) else right
    met = docs.withColumn("__text", F.xxhash64("text")).join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t")), "left")
    lines = F.split("text", "\n")
    lost = F.coalesce(F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(g["first"], g["first"] + g["lines"] - 1)))), F.array().cast("array<int>"))
    met = met.withColumn("__lines", lines).withColumn("__lost", lost)
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    text = F.when(F.size("__lost") == 0, F.col("text")).otherwise(F.array_join(F.transform(places, lambda k: F.get(F.col("__lines"), k)), "\n"))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns]
    return met.select(*out, F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"), F.size("__lost").cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
