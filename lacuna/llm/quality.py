"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents that ``labels`` marks 1; unlabelled web text is drawn from all training
documents, with or without a label (two samples, the second a mixture). With class prior p and the logistic loss l, the risk is
``p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])`` and a step that finds the second term negative climbs
out of it instead (Kiryo et al., 2017). Labels of 0 take no part but to void a label of 1.

p is estimated from the same two samples: networks fitted on the other folds score each row, and above
the best threshold c the share of unlabelled rows over that of positives bounds p (the best bin of Garg
et al., 2021). Rows of equal statistics share a fold. One standard error is taken off, since a p too
large passes bad texts while one too small costs little. Too few positives for the folds give 0.5.

Every whole text is read once for shape statistics (characters by kind, repeated words, pairs and
lines, word lengths); labels, lang, source and doc_id are no inputs of a score. Networks start
on the driver from at most ``POSITIVES`` and ``UNLABELLED`` rows of statistics, chosen by a hash of the
doc_id. The prior's shares are counted over all unlabelled rows, and the last ``FULL_STEPS`` steps follow
the risk's gradient over all of them: tasks sum it, in fixed point, so that reruns agree. Scoring is per
row, everywhere the same.

Labels count only for rows whose crc32(doc_id as text) mod 4 isn't 2. A doc_id with labels of both
kinds has none. A null doc_id has no label and isn't held out. Null and empty texts have zero
statistics and a score like others. Without any training labels every score is the prior 0.5. Repeated
rows get equal scores; an empty table gives an empty table; other columns of the input aren't read by
the classifier, and :func:`keep_good` keeps them whatever their names.
"""

from __future__ import annotations

import zlib
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .storage import fits_broadcast, lean, materialize, release, shielded
from .text import NONSPACE, mix64, text_bytes, word_spans

#: Bound of the labelled sample, and of the unlabelled one that the network starts from.
POSITIVES, UNLABELLED = 8_000, 12_000
#: Steps over all unlabelled rows, and their size.
FULL_STEPS, FULL_RATE = 6, 0.002
#: Folds and steps of the networks that the class prior is read from.
PRIOR_FOLDS, PRIOR_STEPS = 4, 800
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.7
SEED = 7
HIDDEN = 24
#: Texts whose statistics are made together.
SLICE_ROWS = 256

_KINDS = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "stop": [0x2E, 0x2C, 0x3B, 0x3A, 0x3F],
    "shout": [0x21],
    "symbol": [ord(c) for c in "#$%&*+=<>@^_~\\/`"],
    "bar": [ord(c) for c in "|{}[]()"],
    "quote": [0x22, 0x27, 0x2D],
    "line": [0x0A],
    "space": [0x20, 0x09],
    "other": [*range(0x80, 0x100)],
}
_KIND = np.full(256, len(_KINDS), np.uint8)
for _n, _codes in enumerate(_KINDS.values()):
    _KIND[_codes] = _n
_N = len(_KINDS) + 1
_NO_NEWLINE = np.arange(256) != 0x0A
#: Kinds that make a word loud.
_LOUD = np.isin(np.arange(_N), [list(_KINDS).index(k) for k in ("upper", "stop", "shout", "symbol")])
_SPREAD = ("words", "mean_word", "distinct", "same_as_last", "same_as_earlier", "distinct_pairs", "lines", "same_lines", "words_a_line", "one_kind_words", "top_word", "distinct_64")
FEATURES = [f"share_{k}" for k in [*_KINDS, "rest"]] + list(_SPREAD)


def _distinct(owner: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, for each owner (under 2**20 of them)."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    bits = max(int(rows).bit_length(), 1)
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (values >> np.uint64(bits)))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    o = (key[starts] >> np.uint64(64 - bits)).astype(np.int64)
    runs = np.diff(np.append(starts, len(key)))
    most = np.zeros(rows)
    first = np.searchsorted(o, np.arange(rows))
    there = np.flatnonzero(np.diff(np.append(first, len(o))))
    most[there] = np.maximum.reduceat(runs, first[there])
    return np.bincount(o, minlength=rows).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = text_bytes(texts)
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out = np.zeros((rows, len(FEATURES)))
    if not rows:
        return out
    kind = _KIND[data]
    for r in range(rows):
        out[r, :_N] = np.bincount(kind[offsets[r] : offsets[r + 1]], minlength=_N) / size[r]
    found = list(word_spans(data, offsets, NONSPACE))
    starts, ends = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in found]]) for k in (0, 1))
    hashes = np.concatenate([np.zeros(0, np.uint64), *[x[2] for x in found]])
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(owner, minlength=rows).astype(float)
    n = np.maximum(words, 1)
    column = {name: k for k, name in enumerate(FEATURES)}
    put = lambda name, value: out.__setitem__((slice(None), column[name]), value)
    put("words", np.log1p(words) / 10)
    put("mean_word", np.bincount(owner, ends - starts, rows) / n / 10)
    distinct, most = _distinct(owner, hashes, rows)
    put("distinct", distinct / n)
    put("top_word", most / n)
    near = [np.zeros(len(hashes), bool) for _ in range(2)]
    for step in range(1, 9):
        same = np.zeros(len(hashes), bool)
        same[step:] = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
        near[step > 1] |= same
    put("same_as_last", np.bincount(owner, near[0], rows) / n)
    put("same_as_earlier", np.bincount(owner, near[1] | near[0], rows) / n)
    pairs = mix64(hashes[1:] * np.uint64(3) + hashes[:-1]) if len(hashes) else hashes
    within = owner[1:] == owner[:-1]
    put("distinct_pairs", _distinct(owner[1:][within], pairs[within], rows)[0] / np.maximum(np.bincount(owner[1:][within], minlength=rows), 1))
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(rows))[owner]
    block = np.cumsum(place % 64 == 0) - 1  # runs of 64 words
    parts = _distinct(block, hashes, int(block[-1]) + 1 if len(block) else 0)[0]
    put("distinct_64", np.bincount(owner[place % 64 == 0], parts, rows) / n)
    shout = np.concatenate([[0], np.cumsum(_LOUD[kind], dtype=np.int64)])
    put("one_kind_words", np.bincount(owner, (shout[ends] - shout[starts] >= 3) | (2 * (shout[ends] - shout[starts]) > ends - starts), rows) / n)
    found = list(word_spans(data, offsets, _NO_NEWLINE))
    ls = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in found]])
    lh = np.concatenate([np.zeros(0, np.uint64), *[x[2] for x in found]])
    lo = np.searchsorted(offsets, ls, "right") - 1
    lines = np.bincount(lo, minlength=rows).astype(float)
    put("lines", np.log1p(lines) / 10)
    put("same_lines", 1 - (_distinct(lo, lh, rows)[0] + (lines == 0)) / np.maximum(lines, 1))
    put("words_a_line", np.log1p(words / np.maximum(lines, 1)) / 10)
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's digest) and the statistics of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                x = features(part.column(2)).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(lean(run), "doc_id long, key binary, x array<float>")


def text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def risk_gradient(w: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The part of the risk that must not be negative, and the gradient of the step: of the whole risk, or away from a negative part."""
    x = np.concatenate([xp, xu])
    hidden = np.tanh(x @ w[0] + w[1])
    f = hidden @ w[2] + w[3]
    fp, fu = f[: len(xp)], f[len(xp) :]
    negative = float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    if negative >= 0:
        df = np.concatenate([(prior * (sp - 1) - prior * sp) / len(xp), su / len(xu)])
    else:
        df = np.concatenate([prior * sp / len(xp), -su / len(xu)])
    back = np.outer(df, w[2]) * (1 - hidden**2)
    return negative, [x.T @ back, back.sum(0), hidden.T @ df, np.array([df.sum()])]


class Network:
    """One hidden layer, fitted by Adam on the non-negative risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512):
        rng = np.random.default_rng(SEED)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = self._scaled(positive), self._scaled(unlabelled)
        d = p.shape[1]
        w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for step in range(1, steps + 1):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            _, grads = risk_gradient(w, xp, xu, prior)
            grads[0] += 1e-4 * w[0]
            grads[2] += 1e-4 * w[2]
            rate = 0.01 * (1 - 0.9 * step / steps)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


#: Bins of the scores' logits in which shares are counted, and the fixed point in which tasks' sums are added, in any order alike.
BINS, SPAN, FIXED = 4096, 12.0, 1 << 20


def _counts(networks: list[Network], x: np.ndarray) -> np.ndarray:
    """Rows by the logit of their score, by the network that wasn't fitted on them."""
    own = np.array([zlib.crc32(r.tobytes()) % PRIOR_FOLDS for r in x.astype(np.float32)], int)
    out = np.zeros(BINS)
    for k, network in enumerate(networks):
        s = network.scores(x[own == k])
        logit = np.log(np.maximum(s, 1e-300)) - np.log(np.maximum(1 - s, 1e-300))
        at = np.clip((logit + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(int)
        out += np.bincount(at, minlength=BINS)
    return out


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, count: Callable[[list[Network]], np.ndarray] | None = None) -> float:
    """Share of positives among the unlabelled, from scores of rows by networks that weren't fitted on them; ``count`` counts all unlabelled rows, else those given are counted."""
    fp, fu = (np.array([zlib.crc32(r.astype(np.float32).tobytes()) % PRIOR_FOLDS for r in x]) for x in (positive, unlabelled))
    networks = []
    for k in range(PRIOR_FOLDS):
        if not (fp != k).any() or not (fu != k).any():
            return 0.5
        networks.append(Network(positive[fp != k], unlabelled[fu != k], 0.5, PRIOR_STEPS))
    of_p, of_u = _counts(networks, positive), count(networks) if count else _counts(networks, unlabelled)
    n_p, n_u = of_p.sum(), of_u.sum()
    above_p, above_u = (np.cumsum(c[::-1])[::-1] / c.sum() for c in (of_p, of_u))
    slack = np.sqrt(np.log(40) / 2) * (n_p**-0.5 + n_u**-0.5)  # both shares hold at once in 9 cases of 10
    best = np.argmin(np.where(above_p > 0, (above_u + slack) / np.maximum(above_p, 1e-12), np.inf))
    p, q = above_p[best], above_u[best]
    error = np.sqrt(q * (1 - q) / n_u + (q / p) ** 2 * p * (1 - p) / n_p) / p
    return float(np.clip(q / p - error, 0.05, 0.98))


def _summed(table: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(rows)``, ``size`` numbers, over all rows of ``table`` (x); one row of sums a number comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float))
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.round(total * FIXED).astype(np.int64))], ["k", "v"])

    out = np.zeros(size)
    for r in table.select("x").mapInArrow(lean(run), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"] / FIXED
    return out


def unlabelled_sums(network: Network, w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Over rows: the gradient of the loss of calling them negative, flat; the loss; how many they are."""
    scaled = network._scaled(x)
    hidden = np.tanh(scaled @ w[0] + w[1])
    f = hidden @ w[2] + w[3]
    df = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
    back = np.outer(df, w[2]) * (1 - hidden**2)
    return np.concatenate([(scaled.T @ back).ravel(), back.sum(0), hidden.T @ df, [df.sum(), np.logaddexp(0, f).sum(), len(x)]])


def refine(network: Network, table: DataFrame, positive: np.ndarray, prior: float, steps: int = FULL_STEPS) -> None:
    """Steps of Adam on the risk of all rows of ``table`` (x), whose gradients tasks sum, and of the positives."""
    w, p = [x.copy() for x in network.w], network._scaled(positive)
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    ends = np.cumsum([x.size for x in w])
    for step in range(1, steps + 1):
        sums = _summed(table, int(ends[-1]) + 2, lambda x: unlabelled_sums(network, w, x))  # noqa: B023
        loss, n = sums[-2:]
        if not n:
            return
        of_u = [g.reshape(x.shape) / n for g, x in zip(np.split(sums[: ends[-1]], ends[:-1]), w)]
        hidden = np.tanh(p @ w[0] + w[1])
        f = hidden @ w[2] + w[3]
        negative = loss / n - prior * np.logaddexp(0, f).mean()
        df = np.full(len(p), -prior / len(p)) if negative >= 0 else prior / (1 + np.exp(-f)) / len(p)
        back = np.outer(df, w[2]) * (1 - hidden**2)
        sign = 1 if negative >= 0 else -1
        grads = [g + sign * u for g, u in zip((p.T @ back, back.sum(0), hidden.T @ df, np.array([df.sum()])), of_u)]
        grads[0] += 1e-4 * w[0]
        grads[2] += 1e-4 * w[2]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - FULL_RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    network.w = w


def _array(rows) -> np.ndarray:
    return np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))


def fit(table: DataFrame, labels: DataFrame) -> Network | None:
    """A start from a bounded sample of ``table``'s rows; the prior and the last steps are of all unlabelled rows. None without positives."""
    one = labels.where(F.col("quality").isin(0, 1) & (fold() != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    marked = one.where("quality = most").select("doc_id", "quality")
    usable = table.where(F.coalesce(fold() != HELD_OUT, F.lit(True)))
    ids = bounded_sample(marked.where("quality = 1"), SEED, "doc_id", POSITIVES).select("doc_id")
    positive = bounded_sample(usable.join(F.broadcast(ids), "doc_id", "left_semi"), SEED, "doc_id", POSITIVES, "x").select("x").collect()
    if not positive:
        return None
    unlabelled = bounded_sample(usable, SEED + 1, "doc_id", UNLABELLED, "x").select("x").collect()
    p, u = _array(positive), _array(unlabelled)
    prior = estimated_prior(p, u, lambda networks: _summed(usable, BINS, lambda x: _counts(networks, x)))
    network = Network(p, u, prior)
    refine(network, usable, p, prior)
    return network


def score(table: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, key, held_out, score, predicted."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array(part["x"].tolist(), float).reshape(len(part), len(FEATURES))
            s = network.scores(x) if network else np.full(len(part), 0.5)
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "key": part["key"].array, "score": s})

    scored = table.mapInPandas(lean(run), "doc_id long, key binary, score double")
    return scored.select("doc_id", "key", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    table = materialize(feature_table(docs), "quality-features")
    return score(table, fit(table, labels)).drop("key")


@shielded
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; all of them where labels allow no fit. Scores are a text's, so the rejected are known by their texts' digests."""
    table = materialize(feature_table(docs), "quality-features")
    network = fit(table, labels)
    if network is None:
        release(table)
        return docs
    rejected = materialize(score(table, network).where("predicted = 0").select(F.col("key").alias("__key")).distinct(), "quality-rejected")
    release(table)
    side = F.broadcast(rejected) if fits_broadcast(rejected.count(), 48) else rejected
    return docs.join(side, text_key() == F.col("__key"), "left_anti")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
