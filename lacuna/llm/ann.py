"""Approximate nearest neighbours by additive quantisation.

A unit vector is the sum of one full-dimensional codeword from each of ``BOOKS`` codebooks. Codebooks
are fitted on the residuals of a bounded sample of ``SAMPLE`` vectors (chosen by a hash of the id);
every vector is encoded by beam search and indexed with its codes, the norm of its reconstruction and
its fidelity f, the cosine between vector and reconstruction. A query's inner products with all
codewords make a lookup table, so a row's approximate cosine s is a sum of ``BOOKS`` entries over the
stored norm.

The true cosine is ``f s + sqrt(1 - f^2) e`` with an error e of about ``1 / sqrt(d)``. A row goes on to
exact scoring unless its estimate plus ``MARGIN`` such errors stays below the query's fifth best so
far: nothing is capped, so any number of near copies is scored exactly. Exact scores are double
precision cosines of the original vectors, computed for each row in the same order of operations, so
that equal vectors tie exactly.

Queries come in blocks of ``QUERY_BLOCK`` rows (the bound of what is broadcast), each block against all
rows; every task returns at most k rows a query, and a merge by query keeps the best k.

Vectors that are null, zero or hold null or non-finite components, and those of a null id or of another
dimension than most (ties: the smaller), take no part. Rows that share an id are candidates each, and a
query never returns its own id; a query id on several rows asks with its first vector by order. Queries
without candidates return no rows; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .storage import lean, materialize

BOOKS, WORDS, BEAM = 8, 256, 4
SAMPLE = 12_000
ROUNDS = 6
MARGIN = 4.0
K = 5
EVERY = 50
QUERY_BLOCK = 8192
CHUNK = 4096
SEED = 11


@dataclass
class Codebooks:
    books: np.ndarray  # books, words, dimensions

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and reconstructions of unit vectors, by beam search over the books."""
        n, d = x.shape
        m, k, _ = self.books.shape
        rest = x[:, None, :]  # n, beam, d
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in range(m):
            words = self.books[book]
            size = (words**2).sum(1)
            width = rest.shape[1]
            cost = ((rest**2).sum(2)[:, :, None] + size) - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, width, k)
            flat = cost.reshape(n, width * k)
            keep = min(beam, flat.shape[1]) if book < m - 1 else 1
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep > 1 else flat.argmin(1)[:, None]
            parent, word = best // k, best % k
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], 2)
            rest = rest[row, parent] - words[word]
        return codes[:, 0], x - rest[:, 0]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)] + rng.normal(0, 1e-4, (k, x.shape[1]))
    for _ in range(ROUNDS):
        near = ((words**2).sum(1) - 2 * (x @ words.T)).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS) -> Codebooks:
    """Codebooks on the residuals left by those before; ``sample`` are unit vectors."""
    rng = np.random.default_rng(SEED)
    rest, found = sample.astype(np.float32), []
    for _ in range(books):
        book = _kmeans(rest, words, rng).astype(np.float32)
        found.append(book)
        rest = rest - book[((book**2).sum(1) - 2 * (rest @ book.T)).argmin(1)]
    return Codebooks(np.array(found))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten() if rows else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # before squares over- or underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, v, codes, norm and fidelity of every row."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("codes", pa.binary()), ("norm", pa.float32()), ("fidelity", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _unit(_matrix(part.column(1), part.num_rows)).astype(np.float32)
                codes, near = books.encode(x)
                norm = np.sqrt((near**2).sum(1)) + 1e-12
                fidelity = np.clip((x * near).sum(1) / norm, -1, 1)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(schema[1].type), packed, pa.array(norm, pa.float32()), pa.array(fidelity, pa.float32())], schema=schema)

    return materialize(rows.mapInArrow(lean(run), "vec_id long, v array<double>, codes binary, norm float, fidelity float"), "ann-index")


def exact_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in one order of operations; equal rows give equal results."""
    qs, xs = np.abs(q).max(), np.abs(x).max(1)
    a, b = q / qs, x / xs[:, None]
    return (b * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def search_block(index: DataFrame, books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int = K) -> DataFrame:
    """The best k of each task's rows for each of a bounded block of queries."""
    unit = _unit(queries).astype(np.float32)
    d = queries.shape[1]
    tables = np.einsum("qd,bwd->qbw", unit, books.books).astype(np.float32)
    sent = index.sparkSession.sparkContext.broadcast((ids, queries, tables))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, tables = sent.value
        n = len(ids)
        best_s, best_v = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                vec = part.column(0).to_numpy()
                x = _matrix(part.column(1), part.num_rows)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                norm, f = part.column(3).to_numpy(), part.column(4).to_numpy()
                error = MARGIN * np.sqrt(np.maximum(1 - f * f, 0)) / np.sqrt(d) + 1e-5
                scale = f / norm
                for q in range(n):
                    s = tables[q, 0][codes[:, 0]]
                    for b in range(1, codes.shape[1]):
                        s = s + tables[q, b][codes[:, b]]
                    low = s * scale
                    own = vec == ids[q]
                    low[own] = -np.inf
                    floor = best_s[q, -1]
                    if part.num_rows > 8 * k:  # the exact scores of the best estimates are a floor that k rows reach
                        likely = np.argpartition(low, -4 * k)[-4 * k :]
                        likely = likely[~own[likely]]
                        if len(likely) >= k:
                            floor = max(floor, np.partition(exact_cosines(queries[q], x[likely]), -k)[-k])
                    rows = np.flatnonzero((low + error >= floor) & ~own)
                    if not len(rows):
                        continue
                    score = exact_cosines(queries[q], x[rows])
                    better = score >= best_s[q, -1]
                    score, rows = score[better], rows[better]
                    all_s, all_v = np.concatenate([best_s[q], score]), np.concatenate([best_v[q], vec[rows]])
                    order = np.lexsort((all_v, -all_s))[:k]
                    best_s[q], best_v[q] = all_s[order], all_v[order]
        found = np.isfinite(best_s)
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[found.ravel()]), pa.array(best_v[found]), pa.array(best_s[found])], schema=schema)

    return index.select("vec_id", "v", "codes", "norm", "fidelity").mapInArrow(lean(run), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = bounded_sample(rows, SEED, "vec_id", SAMPLE, "v").select("v").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    books = train(_unit(np.array([r["v"] for r in sample])))
    index = build_index(rows, books)
    asked = materialize(index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    count = asked.count()
    if not count:
        return empty
    blocks = -(-count // QUERY_BLOCK)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    parts = []
    for b in range(blocks):  # the driver holds one block of queries at a time
        block = numbered.where(F.col("block") == b).orderBy("vec_id").collect()
        if block:
            parts.append(materialize(search_block(index, books, np.array([r["vec_id"] for r in block]), np.array([r["v"] for r in block]), k), "ann-found"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
