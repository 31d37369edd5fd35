"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased runs of letters and digits. Every whole text is read once and becomes a sequence
of term numbers over the benchmark's vocabulary (words that no item holds can't match and are 0). From
those sequences, over all passages of the corpus (``PASSAGE`` words):

1. term statistics; a term's weight falls with its share of the passages, to ``FLOOR`` of the largest and
   never to 0, since a leak that is itself frequent makes its own terms frequent;
2. a distributed randomised SVD of the TF-IDF matrix A of the passages: tasks add up their share of
   ``A'A W`` for a random W of ``RANK + OVERSAMPLE`` columns, sums meet by term, and the factor follows
   by the Nystroem formula from that one pass (terms x columns, bounded by the benchmark);
3. candidate search: windows of ``PASSAGE`` words at every half passage, also of the items, are
   projected, and a window goes on with every item passage of cosine ``COSINE`` or more, uncapped;
4. the check of a candidate: the longest common subsequence of the item's words and the words around the
   window, as a share of the item. From ``LCS_SURE`` on it is a leak; from ``LCS_LIKELY`` on, as
   paraphrases reach, it is one if the item's answer (its last sentence) is there too: at least
   ``ANSWER`` of the answer's words in the window.

The benchmark is a fixed set beside the corpus: items are handled in blocks of at most ``BLOCK_WORDS``
words, which bounds the vocabulary and with it what the driver and the tasks hold (a longer item is a
block of its own). Each block reads the corpus once.

Null and empty texts, and items without words, match nothing. An item of fewer than ``LEAST`` words is
only found whole and in one run. Repeated rows are judged each; null ids stay null. Long texts are
searched whole. Empty tables give an empty table; extra columns aren't read, and :func:`drop_leaks`
keeps them whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fits_broadcast, lean, materialize, release, shielded, small_batches
from .text import WORDLIKE, words

PASSAGE, FLOOR = 64, 0.1
RANK, OVERSAMPLE = 192, 16
COSINE = 0.45
LCS_SURE, LCS_LIKELY, ANSWER = 0.75, 0.6, 0.7
LEAST = 5
#: Words of the items that are handled together: their terms times RANK + OVERSAMPLE floats are 83 MB at most.
BLOCK_WORDS = 100_000
SEED = 5
_HALF = PASSAGE // 2


@dataclass
class Items:
    """A block of items as sequences of term numbers (1 is the first of the sorted vocabulary)."""

    ids: list[int | None]
    vocabulary: np.ndarray
    sequences: list[np.ndarray]
    answers: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> "Items":
        texts = [t or "" for _, t in rows]
        hashes, bounds = words(pa.array(texts, pa.string()), True, WORDLIKE)
        last = [re.split(r"[.!?\n]+", t.strip().rstrip(".!?"))[-1] for t in texts]
        ends, cuts = words(pa.array(last, pa.string()), True, WORDLIKE)
        vocabulary = np.unique(hashes)
        number = lambda h: (np.searchsorted(vocabulary, h) + 1).astype(np.int64)
        keep = [k for k in range(len(rows)) if bounds[k + 1] > bounds[k]]
        return Items([rows[k][0] for k in keep], vocabulary, [number(hashes[bounds[k] : bounds[k + 1]]) for k in keep], [number(ends[cuts[k] : cuts[k + 1]]) for k in keep])

    @property
    def width(self):
        return np.uint16 if len(self.vocabulary) < 65535 else np.uint32


def sequences(docs: DataFrame, key: str, items: Items) -> DataFrame:
    """``key`` and the term numbers of each whole text, as bytes."""
    schema = pa.schema([("key", pa.int64()), ("terms", pa.binary())])
    vocabulary, width = items.vocabulary, items.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, bounds = words(part.column(1), True, WORDLIKE)
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                terms = np.where(vocabulary[place] == hashes, place + 1, 0).astype(width)
                packed = [terms[bounds[r] : bounds[r + 1]].tobytes() for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], schema=schema)

    return materialize(docs.select(F.col(key).cast("long"), "text").mapInArrow(lean(run), "key long, terms binary"), "leak-sequences")


def _parts(batches: Iterator[pa.RecordBatch], width, words: int = 200_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of some ``words`` words together (a longer row alone), their words and each row's first."""
    for batch in batches:
        ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            begin = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, begin + words * np.dtype(width).itemsize, "right")), at + 1)
            part = batch.slice(at, stop - at)
            at = stop
            packed = part.column(1).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in packed])]) // np.dtype(width).itemsize
            yield part, np.frombuffer(b"".join(packed), width).astype(np.int64), bounds


def _pieces(terms: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its piece of ``size`` words within its row, and each row's first piece (one more at the end)."""
    counts = np.diff(bounds)
    pieces = -(-counts // size)
    first = np.concatenate([[0], np.cumsum(pieces)])
    place = np.arange(len(terms)) - np.repeat(bounds[:-1], counts)
    return np.repeat(first[:-1], counts) + place // size, first


def term_counts(table: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many passages each term is, and the number of passages."""
    size, width = len(items.vocabulary), items.width
    block = max((4 << 20) // (size + 1), 1)  # passages looked at together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size + 1, np.int64), 0
        for _, terms, bounds in _parts(batches, width):
            piece, first = _pieces(terms, bounds, PASSAGE)
            total += int(first[-1])
            known = terms > 0
            for a in range(0, int(first[-1]) if known.any() else 0, block):
                lo, hi = np.searchsorted(piece, [a, a + block])
                there = np.zeros((min(block, int(first[-1]) - a), size + 1), bool)
                there[piece[lo:hi] - a, terms[lo:hi]] = True
                counts[1:] += there[:, 1:].sum(0)
        counts[0] = total
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["term", "n"])

    summed = table.select("key", "terms").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    with small_batches(table.sparkSession):
        rows = summed.collect()  # at most a row a term of the benchmark
    for r in rows:
        counts[r["term"]] = r["n"]
    return counts[1:], int(counts[0])


def _weights(counts: np.ndarray, total: int) -> np.ndarray:
    """IDF by term number (0: none), at least ``FLOOR`` of the largest possible."""
    idf = np.log((1 + total) / (1 + counts))
    return np.concatenate([[0], np.maximum(idf, FLOOR * np.log(2 + total))]).astype(np.float32)


def _weighted(factor: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (factor * weights[:, None]).astype(np.float32)


def _sums(piece: np.ndarray, terms: np.ndarray, weights: np.ndarray, weighted: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the terms' rows of ``weighted`` by piece; which words have weight; squared TF-IDF lengths."""
    own = np.flatnonzero(weights[terms] > 0)
    out, size = np.zeros((pieces, weighted.shape[1]), np.float32), np.zeros(pieces)
    if len(own):
        p, t = piece[own], terms[own]
        begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        for a in range(0, len(begin), 128):  # the gathered rows stay few
            lo, hi = begin[a], begin[a + 128] if a + 128 < len(begin) else len(t)
            out[p[begin[a : a + 128]]] = np.add.reduceat(np.take(weighted, t[lo:hi], axis=0), begin[a : a + 128] - lo, axis=0)
        size = np.bincount(p, weights[t].astype(float) ** 2, pieces)
    return out, own, size


def factorise(table: DataFrame, items: Items, weights: np.ndarray, passages: int, rank: int = RANK, oversample: int = OVERSAMPLE) -> np.ndarray:
    """Right singular vectors (terms + 1 x rank) of the passages' TF-IDF matrix, by one pass and the Nystroem formula."""
    size, width = len(items.vocabulary), items.width
    columns = min(rank + oversample, size)
    random = np.random.default_rng(SEED).normal(size=(size + 1, columns)).astype(np.float32)
    random[0] = 0
    weighted = _weighted(random, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, columns))
        for _, terms, bounds in _parts(batches, width):
            piece, first = _pieces(terms, bounds, PASSAGE)
            projected, own, norm = _sums(piece, terms, weights, weighted, int(first[-1]))
            if not len(own):
                continue
            projected /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)  # rows of A have length 1, on both sides
            order = own[np.argsort(terms[own].astype(width), kind="stable")]
            t = terms[order]
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            for a in range(0, len(begin), 256):  # the gathered rows stay few
                lo, hi = begin[a], begin[a + 256] if a + 256 < len(begin) else len(t)
                total[t[begin[a : a + 256]]] += np.add.reduceat(np.take(projected, piece[order[lo:hi]], axis=0), begin[a : a + 256] - lo, axis=0)
        total *= weights[:, None]
        there = np.flatnonzero(np.abs(total).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(total[there, c].astype(np.float32)) for c in range(columns)]], names=["term", *[f"c{c}" for c in range(columns)]])

    names = [f"c{c}" for c in range(columns)]
    parts = table.select("key", "terms").mapInArrow(lean(run), "term long, " + ", ".join(f"{n} float" for n in names))
    y = np.zeros((size + 1, columns))
    with small_batches(table.sparkSession):
        rows = parts.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).collect()  # at most a row a term of the benchmark
    for r in rows:
        y[r["term"]] = r[1:]
    if len(items.sequences):  # item passages are rows too, and weigh as much as the corpus
        own = np.concatenate(items.sequences)
        piece, first = _pieces(own, np.concatenate([[0], np.cumsum([len(x) for x in items.sequences])]), PASSAGE)
        projected, held, norm = _sums(piece, own, weights, weighted, int(first[-1]))
        projected /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
        share = np.zeros_like(y)
        np.add.at(share, own[held], projected[piece[held]] * weights[own[held], None])
        y += share * (passages / int(first[-1]))
    core = random.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 1e-12) * 1e-7
    if not good.any():
        return np.zeros((size + 1, 1), np.float32)
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank].astype(np.float32)


def _windows(sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all windows of two neighbouring halves (a row's only half alone), and each window's first half."""
    pieces = np.diff(first)
    row = np.repeat(np.arange(len(pieces)), pieces)
    begin = np.arange(len(row)) if len(row) else np.zeros(0, np.int64)
    begin = begin[(begin + 1 < first[row + 1]) | (pieces[row] == 1)] if len(row) else begin
    after = np.minimum(begin + 1, len(sums) - 1)
    both = sums[begin] + np.where((after > begin) & (row[after] == row[begin]), 1, 0)[:, None].astype(np.float32) * sums[after] if len(begin) else sums[:0]
    length = np.sqrt((both**2).sum(1))
    there = length > 1e-6
    return both[there] / length[there, None], begin[there]


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with a's positions as bits of one number."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | (1 << k)
    mask = (1 << len(a)) - 1
    row = mask
    for x in b.tolist():
        if m := at.get(x):
            both = row & m
            row = ((row + both) | (row - both)) & mask
    return len(a) - row.bit_count()


def _check(item: np.ndarray, answer: np.ndarray, around: np.ndarray) -> tuple[float, float]:
    """Shares of the item and of its answer that are there."""
    held = np.isin(answer, around).mean() if len(answer) else 1.0
    return lcs_length(item, around) / len(item), float(held)


def is_leak(length: int, share: float, answer: float) -> bool:
    if length < LEAST:
        return share == 1
    return share >= LCS_SURE or (share >= LCS_LIKELY and answer >= ANSWER)


FOUND = "key long, item long, share double, answer double, word long"


def search(table: DataFrame, items: Items, weights: np.ndarray, factor: np.ndarray) -> DataFrame:
    """key, item (its place in the block), share, answer and the first word of the best window of every leak."""
    width = items.width
    lengths = np.array([len(s) for s in items.sequences])
    bounds_i = np.concatenate([[0], np.cumsum(lengths)])
    terms_i = np.concatenate(items.sequences)
    piece, first = _pieces(terms_i, bounds_i, _HALF)
    weighted = _weighted(factor, weights)
    probes, begin = _windows(_sums(piece, terms_i, weights, weighted, int(first[-1]))[0], first)
    owner = np.searchsorted(first, begin, "right") - 1
    offset = (begin - first[owner]) * _HALF
    short = [k for k in range(len(lengths)) if lengths[k] < LEAST or k not in set(owner.tolist())]  # no weighted term or few words: sought as they are
    schema = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("share", pa.float64()), ("answer", pa.float64()), ("word", pa.int64())])
    own_items, own_answers = items.sequences, items.answers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, terms, bounds in _parts(batches, width):
            piece, first = _pieces(terms, bounds, _HALF)
            vectors, at = _windows(_sums(piece, terms, weights, weighted, int(first[-1]))[0], first) if len(terms) else (factor[:0], np.zeros(0, np.int64))
            best: dict[tuple[int, int], tuple] = {}
            for a in range(0, len(vectors), 4096):
                window, probe = np.nonzero(vectors[a : a + 4096] @ probes.T >= COSINE) if len(probes) else ((), ())
                for w, p in zip(at[a + np.asarray(window, np.int64)].tolist(), np.asarray(probe).tolist()):
                    item = int(owner[p])
                    row = int(np.searchsorted(first, w, "right")) - 1
                    word = (w - int(first[row])) * _HALF
                    lo = max(bounds[row] + word - int(offset[p]) - _HALF, bounds[row])
                    hi = min(bounds[row] + word - int(offset[p]) + max(int(lengths[item]), PASSAGE) + _HALF, bounds[row + 1])
                    share, answer = _check(own_items[item], own_answers[item], terms[lo:hi])
                    if is_leak(int(lengths[item]), share, answer) and (share, answer, -word) > best.get((row, item), (0.0, 0.0, 1)):
                        best[row, item] = (share, answer, -word)
            for item in short:
                want = own_items[item]
                n = len(want)
                if len(terms) < n:
                    continue
                hit = np.ones(len(terms) - n + 1, bool)
                for k in range(n):
                    hit &= terms[k : k + len(hit)] == want[k]
                for start in np.flatnonzero(hit).tolist():
                    row = int(np.searchsorted(bounds, start, "right")) - 1
                    if start + n <= bounds[row + 1] and (row, item) not in best:
                        best[row, item] = (1.0, 1.0, -(start - int(bounds[row])))
            if best:
                keys = part.column(0).to_pylist()
                rows = [(keys[r], i, s, a, -w) for (r, i), (s, a, w) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    return table.select("key", "terms").mapInArrow(lean(run), FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` (key, text) against ``benchmark`` (item_id, text): a row for each document and item that it holds.

    Columns: the key, item_id, lcs_share, answer_share, word (where the window begins)."""
    spark = docs.sparkSession
    result = spark.createDataFrame([], f"{key} long, item_id long, lcs_share double, answer_share double, word long")
    size = F.size(F.split("text", "[^0-9A-Za-z\\u0080-\\uffff]+")).cast("long")
    numbered = materialize(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), F.coalesce(size, F.lit(0).cast("long")).alias("words")), "benchmark")
    total = numbered.agg(F.sum("words")).first()[0] or 0
    blocks = max(-(-2 * total // BLOCK_WORDS), 1) if total > BLOCK_WORDS else 1  # half full on average, so that none is over
    for b in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        items = Items.of(rows)
        if not items.ids:
            continue
        table = sequences(docs, key, items)
        counts, passages = term_counts(table, items)
        weights = _weights(counts, passages)
        found = materialize(search(table, items, weights, factorise(table, items, weights, passages)), "leaks")
        release(table)
        names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long"))
        result = result.unionByName(found.join(names, "item").select(F.col("key").alias(key), "item_id", F.col("share").alias("lcs_share"), F.col("answer").alias("answer_share"), "word"))
    release(numbered)
    return result


@shielded
def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; decided by text, so that ids may repeat."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    found = find_leaks(docs.select(digest.alias("__text"), "text"), benchmark, "__text").select("__text").distinct()
    leaked = materialize(found, "leaked")
    side = F.broadcast(leaked) if fits_broadcast(leaked.count(), 24) else leaked
    return docs.join(side, digest == F.col("__text"), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
