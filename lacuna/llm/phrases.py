"""Phrase collocation mining by pattern growth over projected occurrences, in the manner of PrefixSpan.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at spaces and
tabs; everything is counted a language. Only phrases of frequent parts can be frequent, so:

1. words are counted; those of ``min_count`` occurrences are the first prefixes;
2. every occurrence of a prefix is projected to what follows it in its piece, up to ``max_words`` words and the
   first infrequent one. Equal projections are counted where they arise, before they are exchanged;
3. a prefix's projections meet in one task, in order, and the task extends the prefix to the right depth-first:
   a projection's next word makes a longer prefix, and deeper words are only looked at inside frequent ones.
   A task holds a batch and one open prefix a depth, whatever the number of projections.

A word with a 1000th of all occurrences or more is a hot prefix. Of these there are 1000 at most; the
projections of a hot prefix are dealt out by their next word, too, whose extensions don't depend on each
other. The frequent words are sent to the tasks of step 2 if their counted number allows it; without them
projections just aren't cut at infrequent words, which changes no result.

Then each phrase is cut in two everywhere, the parts' counts are joined to it, and scores are exact decimals.
The best of a language are found within ``SALTS`` parts first, so that one task ranks ``SALTS * top`` rows at most.

A null text has no words; a null lang counts as ``und``. Empty pieces have no words, and neither phrases nor
overlaps cross pieces or rows. Repeated rows count each; doc_id isn't read, nor are further columns, so nothing
can clash. Texts are read whole, in slices that end between pieces. Ties of scores go by count, then by the
phrase's bytes. An empty table gives no phrases.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fits_broadcast, lean, materialize, release
from .text import _slices, text_bytes

MAX_WORDS, MIN_COUNT, ABSORB_PERCENT, TOP = 3, 10, 50, 2000
#: A hot prefix has at least one of so many parts of all words.
HOT = 1000
SALTS = 32
#: Words counted together by a task before they are sent on, and rows of a batch of projections; a task's Python memory follows them.
FLUSH, ROWS = 500_000, 50_000
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PIECE = np.ones(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = False
_WORD = _PIECE.copy()
_WORD[[0x20, 0x09]] = False


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def words_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For slices of the texts: lower-cased words, the row of each, and whether the next word continues its piece."""
    data, offsets = text_bytes(texts)
    for a, b in _slices(data, offsets, _PIECE):
        part = _LOWER[data[a:b]]
        inside = _WORD[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        first[rows[rows < len(part)]] = True
        first &= inside
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        row = np.searchsorted(offsets, starts + a, "right") - 1
        piece = np.cumsum(~_PIECE[part], dtype=np.int64)[starts]
        linked = np.append((piece[1:] == piece[:-1]) & (row[1:] == row[:-1]), False)
        begin = np.cumsum(inside, dtype=np.int64)[starts] - 1
        yield _strings(part[inside], np.append(begin, int(inside.sum()))), row, linked


class _Buffer:
    """Words of many slices: their heads (lang, tab, word) by number, and their links."""

    def __init__(self) -> None:
        self.words, self.langs, self.linked, self.n = [], [], [], 0

    def add(self, words: pa.Array, langs: pa.Array, linked: np.ndarray) -> None:
        self.words.append(words)
        self.langs.append(langs)
        self.linked.append(linked)
        self.n += len(words)

    def take(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Number of each word's (lang, word), the langs and words by number, links; empties the buffer."""
        word, words = _codes(pa.concat_arrays(self.words))
        lang, langs = _codes(pa.concat_arrays(self.langs))
        own, pairs = _codes(pa.array(lang * len(words) + word))
        pairs = pairs.to_numpy()
        linked = np.concatenate(self.linked)
        self.__init__()
        return own, langs.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), linked


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    held = _Buffer()
    for batch in batches:
        langs = batch.column("lang").cast(pa.large_string())
        for words, row, linked in words_of(batch.column("text")):
            held.add(words, langs.take(pa.array(row)), linked)
            if held.n >= FLUSH:
                yield held.take()
    if held.n:
        yield held.take()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, langs, words, linked in _buffers(batches):
        counts = pa.array(np.bincount(own, minlength=len(words)))
        yield pa.record_batch([langs.cast(pa.string()), words.cast(pa.string()), counts], ["lang", "phrase", "n"])
        del own, langs, words, linked, counts  # or they live on beside the next ones


def _heads(langs: pa.Array, words: pa.Array) -> pa.Array:
    """A word has no tab, so the last one parts it from its lang."""
    return pc.binary_join_element_wise(langs.cast(pa.large_string()), words.cast(pa.large_string()), pa.scalar("\t", pa.large_string()))


def _project(frequent, max_words: int):
    """Projections (head, tail, n): each word of a tail is followed by a space. ``frequent``: broadcast heads, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(frequent.value).read_all().column(0).combine_chunks() if frequent is not None else None
        for held in _buffers(batches):
            yield from _projections(*held, known, max_words)
            del held  # or it lives on beside the next ones

    return run


def _projections(own: np.ndarray, langs: pa.Array, words: pa.Array, linked: np.ndarray, known: pa.Array | None, max_words: int) -> Iterator[pa.RecordBatch]:
    """Of one buffer, by head, ``ROWS`` at a time: strings are only made for the rows that are sent."""
    heads = _heads(langs, words)
    keep = pc.is_in(heads, value_set=known).to_numpy(zero_copy_only=False) if known is not None else np.ones(len(heads), bool)
    base, n = len(heads) + 1, len(own)
    held = keep[own]
    at = np.flatnonzero(held & linked)
    at = at[held[at + 1]]
    code, alive, levels = own[at] + 1, np.ones(len(at), bool), []
    for k in range(1, max_words):
        before = at + (k - 1)
        alive = alive & linked[np.minimum(before, n - 1)]
        nxt = np.minimum(at + k, n - 1)
        alive &= held[nxt]
        code, distinct = _codes(pa.array(code * base + np.where(alive, own[nxt] + 1, 0)))
        levels.append(distinct.to_numpy())
    counts = np.bincount(code, minlength=len(levels[-1])) if len(at) else np.zeros(0, np.int64)
    del own, linked, held, at, code, alive, before, nxt
    numbers, left = [], np.arange(len(counts))
    for distinct in reversed(levels):
        left, last = np.divmod(distinct[left], base)
        numbers.insert(0, last)
    order = np.argsort(left * base + numbers[0])
    spaced = pa.concat_arrays([pa.array([""], pa.large_string()), pc.binary_join_element_wise(words, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))])
    for k in range(0, len(order), ROWS):
        some = order[k : k + ROWS]
        tails = pc.binary_join_element_wise(*[spaced.take(pa.array(x[some])) for x in numbers], pa.scalar("", pa.large_string()))
        yield pa.record_batch([heads.take(pa.array(left[some] - 1)).cast(pa.string()), tails.cast(pa.string()), pa.array(counts[some])], ["head", "tail", "n"])


def _grow(max_words: int, min_count: int):
    """(lang, phrase, words, n) of frequent extensions, from ordered projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[tuple[tuple, int]] = [((), 0)] * max_words  # the last prefix of each depth, which the next batch may go on with

        def end(depth: int) -> Iterator[tuple]:
            key, n = opened[depth]
            if n >= min_count:
                lang, _, word = key[0].rpartition("\t")
                yield lang, word + " " + "".join(key[1:]).rstrip(" "), depth + 1, n
            opened[depth] = ((), 0)

        for batch in batches:
            if not len(batch):
                continue
            head, heads = _codes(batch.column("head").cast(pa.large_string()))
            data, offsets = text_bytes(batch.column("tail"))
            stops = np.flatnonzero(data == 0x20) + 1
            word, words = _codes(_strings(data, np.concatenate([[0], stops])))
            first = np.searchsorted(stops, offsets, "right")  # of each row's words
            own = np.diff(first)
            counts = batch.column("n").to_numpy()
            rows, changed = np.arange(len(batch)), np.concatenate([[True], head[1:] != head[:-1]])
            path: list[np.ndarray] = []
            some: list[tuple] = []
            for depth in range(1, max_words):
                last = np.where(own[rows] >= depth, word[np.minimum(first[rows] + depth - 1, len(word) - 1)], -1)
                path.append(last)
                changed = changed | np.concatenate([[True], last[1:] != last[:-1]])
                begin = np.flatnonzero(changed)
                total = np.add.reduceat(counts[rows], begin)
                key = lambda i: (heads[int(head[rows[i]])].as_py(), *[words[int(p[i])].as_py() for p in path])
                whole = last[begin] >= 0
                if whole[0]:
                    if (k := key(begin[0])) == opened[depth][0]:
                        total[0] += opened[depth][1]
                        opened[depth] = ((), 0)
                some += end(depth)
                enough = whole & (total >= min_count)
                if whole[-1]:  # this prefix stays open
                    opened[depth] = (key(begin[-1]), int(total[-1]))
                    enough[-1] = False
                if enough.any():
                    at = begin[enough]
                    langs, own_words = _parted(heads.take(pa.array(head[rows[at]])))
                    joined = pc.binary_join_element_wise(own_words, *[_bare(words.take(pa.array(p[at]))) for p in path], pa.scalar(" ", pa.large_string()))
                    yield _found(langs, joined, np.full(len(at), depth + 1), total[enough])
                deeper = np.repeat(whole & (total >= min_count), np.diff(np.append(begin, len(rows))))
                for edge in (0, -1):  # what came before or comes after may make these frequent
                    if whole[edge]:
                        deeper[begin[edge] : (begin[1] if edge == 0 and len(begin) > 1 else len(rows))] = True
                if not deeper.any():
                    break
                rows, path, changed = rows[deeper], [p[deeper] for p in path], _first_kept(changed, deeper)
            if some:
                yield _found(*[pa.array([x[k] for x in some], pa.large_string()) for k in (0, 1)], np.array([x[2] for x in some]), np.array([x[3] for x in some]))
        some = [x for depth in range(1, max_words) for x in end(depth)]
        if some:
            yield _found(*[pa.array([x[k] for x in some], pa.large_string()) for k in (0, 1)], np.array([x[2] for x in some]), np.array([x[3] for x in some]))

    return run


def _first_kept(changed: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Runs are kept or dropped whole, so their first rows stay first."""
    out = changed[kept]
    out[0] = True
    return out


def _parted(heads: pa.Array) -> tuple[pa.Array, pa.Array]:
    lists = pc.split_pattern(heads, "\t", max_splits=1, reverse=True)
    return pc.list_element(lists, 0), pc.list_element(lists, 1)


def _bare(words: pa.Array) -> pa.Array:
    return pc.binary_replace_slice(words.cast(pa.large_binary()), -1, 2**31 - 1, b"").cast(pa.large_string())


def _found(langs: pa.Array, phrases: pa.Array, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(words.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "words", "n"])


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words; written."""
    counted = _read(docs).mapInArrow(lean(_count), "lang string, phrase string, n long")
    return materialize(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrase-words")


def grow(docs: DataFrame, words: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 2 to ``max_words`` words that occur ``min_count`` times; ``words`` from :func:`count_words`. Written."""
    spark = docs.sparkSession
    frequent = words.where(F.col("n") >= min_count)
    sent = None
    if fits_broadcast(frequent.count(), 48):
        heads = frequent.select(F.concat("lang", F.lit("\t"), "phrase").alias("head")).toArrow()
        sink = pa.BufferOutputStream()
        heads = pa.table({"head": heads.column(0).cast(pa.large_string())})
        with pa.ipc.new_stream(sink, heads.schema) as stream:
            stream.write_table(heads)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = words.where(F.col("n") * HOT >= F.lit(total)).select(F.concat("lang", F.lit("\t"), "phrase").alias("hot"))  # HOT rows at most
    projected = _read(docs).mapInArrow(lean(_project(sent, max_words)), "head string, tail string, n long")
    dealt = projected.join(F.broadcast(hot), F.col("head") == F.col("hot"), "left")
    key = F.xxhash64("head", F.when(F.col("hot").isNotNull(), F.substring_index("tail", " ", 1)))
    ordered = dealt.select(key.alias("h"), "head", "tail", "n").repartition("h").sortWithinPartitions("h", "head", "tail")
    found = ordered.select("head", "tail", "n").mapInArrow(lean(_grow(max_words, min_count)), "lang string, phrase string, words int, n long")
    return materialize(found, "phrase-found")


def _exact(c: str | Column) -> Column:
    return F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): the cut of the lowest score, ties to the first."""
    counts = materialize(phrases.select("lang", "phrase", "n").unionByName(words.select("lang", "phrase", "n")), "phrase-counts")
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    cuts = cuts.withColumn("left", part(F.col("k"))).withColumn("right", part(F.col("k") - F.col("words")))
    side = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = met.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def absorbed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the count of the most frequent longer phrase that holds the phrase."""
    parts = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(parts, i, m), ' '))))")
    inner = phrases.where("words > 2").withColumn("parts", parts).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, absorb_percent: int = ABSORB_PERCENT, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), best first; all of them without ``top``."""
    words = count_words(docs)
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    phrases = grow(docs, words, max_words, min_count)
    kept = phrases.join(absorbed(phrases), ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < absorb_percent * F.col("n")))
    rows = materialize(scored(phrases, words.where(F.col("n") >= min_count)).join(kept.select("lang", "phrase"), ["lang", "phrase"], "left_semi"), "phrase-scored")
    release(words, phrases)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        rows = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top).drop("at", "salt")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM candidates
  UNION ALL
  SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
), scores AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE k = 3
  UNION ALL
  SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE k = 3
), longest AS (
  SELECT lang, phrase, MAX(a) AS a FROM longer GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
