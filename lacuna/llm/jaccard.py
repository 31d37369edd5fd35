"""N-gram Jaccard join by chosen paths.

A document is its set of distinct ``SHINGLE``-word shingles (words: runs of other than ASCII white
space; a shorter text is one shingle of all its words). In each of ``RUNS`` runs sets are split on a
sampled token, the one of least value under the run's hash, which two sets share with probability of
their Jaccard similarity J. A bucket of over ``LEAF`` sets is split again on the next sampled token, up
to ``DEPTH`` times. A pair meets in a run with probability at least J**DEPTH, so the runs follow from
the target recall at the threshold: ``(1 - 0.8**3) ** RUNS`` is below 1e-3.

Sets that are equal are one class and are never compared with each other. Sets that meet are linked only
if their sketches (the least token of each of ``BINS`` ranges, 8 bits each) agree in ``AGREE`` of the
filled ranges: pairs at 0.8 do but for about 3e-5, pairs at 0.57 (texts around one shared passage) don't
but for about 1e-5. In a bucket of up to ``LEAF`` sets all pairs are looked at. In one that is still
larger after ``DEPTH`` tokens each set is compared with the least one. If all agree, these links join the
bucket; else its sets are split on by further tokens until small groups are left, in which all pairs are
looked at, so that sets which only share a passage part again. That happens in one task for a bucket of
up to ``GROUP`` sets, ``BRANCHES`` times side by side in different orders of tokens: a pair at 0.8 that
needs k tokens more still meets with probability ``0.8**3 * (1 - (1 - 0.8**k) ** BRANCHES)`` a run. Larger
buckets are split by shuffles first, up to ``DEEPER`` levels. What is larger even then is joined by its
least set unseen, which costs comparisons and no links.

A bucket of n sets gives at most n - 1 links, and a set's links of all runs are contracted to its least
neighbour before components are sought. Components hold every pair that met. The sets of a component
are then brought together once and all its pairs compared exactly; a component of over ``BLOCK`` sets or
``BLOCK_TOKENS`` tokens is cut in blocks and compared block pair by block pair, each a task's group of
its own. Pairs are counted where they are compared and never written: every document gets its class
(the least doc_id among documents joined by links) and its number of links, which counts every document
of similarity 0.8 or more.

Null, empty and blank texts have no shingles: they are a class each (their own doc_id) without links. Null
doc_ids are documents like others. Repeated rows are copies of each other and counted as such. Long
texts are whole sets. An empty table gives an empty table; extra columns aren't read, and
:func:`keep_one` keeps them whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .storage import fits_broadcast, lean, materialize, release, shielded
from .text import mix64, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
DEPTH, TARGET_RECALL = 3, 0.999
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - THRESHOLD**DEPTH))
LEAF = 100
#: Ranges of a sketch, and the share of the filled ones in which sets of 0.8 agree.
BINS, AGREE = 256, 0.7
#: Sets of a bucket that one task splits on, orders of tokens it tries, and sets of a group it compares pair by pair.
GROUP, BRANCHES, WIDE = 5000, 4, 300
#: Levels at most by which buckets beyond GROUP are split on.
DEEPER = 20
BLOCK, BLOCK_TOKENS = 1000, 1_000_000
_HASHES = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, RUNS * DEPTH, dtype=np.uint64) | np.uint64(1)
_ROW = "doc_id long, key binary, sig binary, n int, paths array<array<long>>, least binary, sketch binary"


def _signature(tokens: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = np.bitwise_xor.reduce(mix64(tokens + np.uint64(1)))
    b = np.add.reduce(mix64(tokens ^ np.uint64(0xABCDEF0123456789)))
    return np.array([a, b], np.uint64).tobytes()


def _sketches(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row a set: 8 bits of the least token of each range, 0 for an empty one. Tokens are sorted within sets."""
    out = np.zeros((len(bounds) - 1, BINS), np.uint8)
    if len(tokens):
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place = owner * BINS + (tokens >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.reshape(-1)[place[first]] = 1 + tokens[first] % np.uint64(255)
    return out


def _alike(n: np.ndarray, sketch: np.ndarray, other_n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets (their sizes and sketches, row by row) may have a similarity of THRESHOLD."""
    sized = np.minimum(n, other_n) >= THRESHOLD * np.maximum(n, other_n) - 1e-9
    out = np.zeros(len(n), bool)
    at = np.flatnonzero(sized)
    x, y = sketch[at], other[at] if len(other) == len(n) else other
    out[at] = ((x == y) & (x > 0)).sum(1) >= AGREE * ((x | y) > 0).sum(1)
    return out


def _stacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("sig", pa.binary()), ("n", pa.int32()), ("paths", pa.list_(pa.list_(pa.int64()))), ("least", pa.binary()), ("sketch", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            tokens, bounds = shingles(*words(part.column(2)), SHINGLE)
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            sig = [None] * part.num_rows
            for r in full:
                sig[r] = _signature(tokens[bounds[r] : bounds[r + 1]])
            least = np.zeros((part.num_rows, RUNS * DEPTH), np.uint64)
            if len(full):
                for h, factor in enumerate(_HASHES):
                    least[full, h] = np.minimum.reduceat(tokens * factor, bounds[:-1][full])
            paths = np.zeros((part.num_rows, RUNS, DEPTH), np.uint64)
            for run in range(RUNS):
                path = np.full(part.num_rows, run + 1, np.uint64)
                for level in range(DEPTH):
                    path = mix64(path * np.uint64(31) + least[:, run * DEPTH + level])
                    paths[:, run, level] = path
            inner = pa.ListArray.from_arrays(np.arange(0, paths.size + 1, DEPTH, dtype=np.int32), pa.array(paths.view(np.int64).ravel()))
            outer = pa.ListArray.from_arrays(np.arange(0, len(inner) + 1, RUNS, dtype=np.int32), inner)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (mix64(least).astype(np.uint16), _sketches(tokens, bounds))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sig, pa.binary()), pa.array(counts, pa.int32()), outer, *packed], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Tables that end where the value of the sorted column changes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(column)[batch.num_rows - 1]
        lo, hi = 0, batch.num_rows - 1  # the first row of the last group
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if batch.column(column)[mid] == last else (mid + 1, hi)
        if lo or (kept and kept[-1].column(column)[kept[-1].num_rows - 1] != last):
            if kept or lo:
                yield pa.Table.from_batches([*kept, batch.slice(0, lo)])
            kept = []
        kept.append(batch.slice(lo))
    if kept:
        yield pa.Table.from_batches(kept)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def _all_pairs(own: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs among the places ``own`` that agree."""
    found = []
    for k in range(len(own) - 1):
        more = own[k + 1 :]
        more = more[_alike(n[more], sketch[more], n[own[k]], sketch[own[k]][None])]
        if len(more):
            found.append((more, np.full(len(more), own[k])))
    return found


def _divide(own: np.ndarray, at: int, used: int, n: np.ndarray, sketch: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the places ``own`` (of one bucket) that agree, split on by the tokens from number ``at`` on. used: tokens so far."""
    if len(own) <= WIDE:
        return _all_pairs(own, n, sketch)
    ok = _alike(n[own], sketch[own], n[own[0]], sketch[own[0]][None])
    ok[0] = False
    found = [(own[ok], np.full(ok.sum(), own[0]))]
    rest = own[1:][~ok[1:]]
    if not len(rest):
        return found
    if used >= least.shape[1]:  # all tokens agree: the others are compared with the least of them
        return found + _divide(rest, at, used, n, sketch, least)
    for way in range(BRANCHES if used == DEPTH else 1):
        k = (at + way * (least.shape[1] - DEPTH) // BRANCHES) % least.shape[1]
        order = own[np.argsort(least[own, k], kind="stable")]
        cuts = np.flatnonzero(np.diff(least[order, k])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                found += _divide(np.sort(part), k + 1, used + 1, n, sketch, least)
    return found


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets: rows (leaf, sig, n, sketch, at, least) sorted by leaf and sig; at: the next token to split a large one on, else -1. A link's b is the lesser one."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for table in _cut(batches, 0):
        leaf, n, at = (table.column(k).to_numpy() for k in (0, 2, 4))
        sig = table.column(1).combine_chunks()
        sketch = _stacked(table.column(3))
        pairs = []
        for step in range(1, len(leaf)):
            same = np.flatnonzero((leaf[:-step] == leaf[step:]) & (at[step:] < 0))
            if not len(same):
                break
            same = same[_alike(n[same], sketch[same], n[same + step], sketch[same + step])]
            pairs.append((same, same + step))
        large = np.flatnonzero(at >= 0)
        if len(large):
            least = np.zeros((len(leaf), RUNS * DEPTH), np.uint16)
            least[large] = np.frombuffer(b"".join(table.column(5).take(pa.array(large)).to_pylist()), np.uint16).reshape(len(large), -1)
            for part in np.split(large, np.flatnonzero(np.diff(leaf[large])) + 1):
                pairs += _divide(part, int(at[part[0]]), DEPTH, n, sketch, least)
        if not pairs:
            continue
        root = _roots(len(leaf), *(np.concatenate(x) for x in zip(*pairs)))
        own = np.flatnonzero(root != np.arange(len(leaf)))
        if len(own):
            yield pa.RecordBatch.from_arrays([sig.take(pa.array(own)), sig.take(pa.array(root[own]))], schema=schema)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, at, a, b, n, sketch, n and sketch of b) with whether the two agree."""
    schema = pa.schema([("path", pa.int64()), ("at", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ok", pa.bool_())])
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            ok = _alike(part.column(4).to_numpy(), _stacked(part.column(5)), part.column(6).to_numpy(), _stacked(part.column(7)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(ok)], schema=schema)


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of buckets of two or more, with their number c. Both sides are written: Spark broadcasts the counts or splits hot buckets."""
    counts = materialize(rows.groupBy(path).agg(F.count("*").alias("c")).where("c > 1"), "jaccard-counts")
    held = materialize(rows.join(F.broadcast(counts) if fits_broadcast(counts.count(), 24) else counts, path), "jaccard-buckets")
    release(counts)
    return held


def _judged(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Sets of large buckets (path, at, sig) compared with their bucket's least: (path, at, a, b, ok)."""
    first = materialize(rows.groupBy("path").agg(F.min("sig").alias("b")), "jaccard-first")
    known = first.join(reps.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b")), "b")
    pairs = rows.join(F.broadcast(known) if fits_broadcast(first.count(), BINS + 64) else known, "path").join(reps.select("sig", "n", "sketch"), "sig")
    pairs = pairs.select("path", "at", F.col("sig").alias("a"), "b", "n", "sketch", "nb", "sketch_b")
    out = materialize(pairs.mapInArrow(lean(_judge), "path long, at int, a binary, b binary, ok boolean"), "jaccard-judged")
    release(first)
    return out


def _leaves(reps: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Buckets to compare (leaf, sig, at: -1 for LEAF sets at most), links that join larger ones than GROUP, and written tables they read."""
    rows = reps.select("sig", F.posexplode("paths").alias("run", "p")).select("sig", "run", *[F.col("p")[k].alias(f"p{k}") for k in range(DEPTH)])
    small, links, written = [], [], []
    for level in range(DEPTH):
        path = f"p{level}"
        held = _counted(rows, path)
        written.append(held)
        small.append(held.where(F.col("c") <= LEAF).select(F.col(path).alias("leaf"), "sig", F.lit(-1).alias("at")))
        rows = held.where(F.col("c") > LEAF).drop("c")
        if rows.isEmpty():
            break
    else:
        held = held.select(F.col(path).alias("path"), "sig", (F.col("run") * DEPTH + DEPTH).alias("at"), "c").where(F.col("c") > LEAF)
        for level in range(DEEPER + 1):
            small.append(held.where(F.col("c") <= GROUP).select(F.col("path").alias("leaf"), "sig", F.pmod("at", F.lit(RUNS * DEPTH)).alias("at")))
            rows = held.where(F.col("c") > GROUP)
            if rows.isEmpty():
                break
            if level == DEEPER:
                first = materialize(rows.groupBy("path").agg(F.min("sig").alias("b")), "jaccard-first")
                written.append(first)
                links.append(rows.join(first, "path").where("sig <> b").select(F.col("sig").alias("a"), "b"))
                break
            judged = _judged(rows, reps)
            links.append(judged.where("ok AND a <> b").select("a", "b"))
            split = judged.where("NOT ok").select("path").distinct()
            left = judged.join(F.broadcast(split) if fits_broadcast(split.count(), 24) else split, "path", "left_semi").select("path", "at", F.col("a").alias("sig"))
            token = F.substring("least", F.pmod("at", F.lit(RUNS * DEPTH)) * 2 + 1, F.lit(2))
            chosen = left.join(reps.select("sig", "least"), "sig").select(F.xxhash64("path", token).alias("path"), (F.col("at") + 1).alias("at"), "sig")
            held = _counted(chosen, "path")
            written += [judged, held]
    none = reps.sparkSession.createDataFrame([], "a binary, b binary")
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, links, none), written


def _contracted(links: DataFrame) -> DataFrame:
    """Links of equal components: of a set's neighbours (a few a run, all less than it) only the least keeps its link, and has the others'."""
    near = links.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("near"))
    ends = F.transform("near", lambda x, k: F.struct(F.when(k == 0, F.col("a")).otherwise(x).alias("a"), F.get("near", F.lit(0)).alias("b")))
    return near.select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within groups: rows (grp, side, sig, n_docs, tokens) sorted by grp. side: 0 or 1 of a block pair, 2 of a block with itself."""
    schema = pa.schema([("sig", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])
    for table in _cut(batches, 0):
        grp, side = table.column(0).combine_chunks(), table.column(1).to_numpy()
        sigs, weight = table.column(2).to_pylist(), table.column(3).to_numpy()
        packed = table.column(4).to_pylist()
        names = grp.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        out: list[tuple] = []
        for lo, hi in zip(cuts, cuts[1:]):
            keep = list({(sigs[k], int(side[k])): k for k in range(lo, hi)}.values())  # a repeated row's set came twice
            if len(keep) > 1:
                out += _pairs([sigs[k] for k in keep], side[keep], weight[keep], [np.frombuffer(packed[k], np.uint64) for k in keep])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(schema)], schema=schema)


def _pairs(sigs: list[bytes], side: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
    n, sizes = len(sets), np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by_token = np.argsort(token, kind="stable")
    posting = owner[by_token]
    begin = np.searchsorted(token[by_token], np.arange(token.max() + 1))
    length = np.diff(np.append(begin, len(posting)))
    links, a, b = np.zeros(n, np.int64), [], []
    for i in range(n):
        own = token[bounds[i] : bounds[i + 1]]
        own = own[length[own] > 1]
        if not len(own):
            continue
        counts = length[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(posting[at], minlength=n)
        near = np.flatnonzero(shared >= THRESHOLD * (sizes + sizes[i] - shared) - 1e-9)
        near = near[(near != i) & ((side[near] != side[i]) | (side[i] == 2))]
        links[i] = weight[near].sum()
        near = near[near > i]
        a.append(np.full(len(near), i))
        b.append(near)
    if not a:
        return []
    root = _roots(n, np.concatenate(a), np.concatenate(b))
    low = {}
    for k in range(n):
        low[root[k]] = min(low.get(root[k], sigs[k]), sigs[k])
    return [(sigs[k], low[root[k]], int(links[k])) for k in range(n) if links[k]]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("comp", pa.binary()), ("blocks", pa.int64()), ("sig", pa.binary()), ("n_docs", pa.int64()), ("tokens", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            tokens, bounds = shingles(*words(part.column(4)), SHINGLE)
            packed = [tokens[bounds[r] : bounds[r + 1]].tobytes() for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(packed, pa.binary())], schema=schema)


def _classes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to a row a document: doc_id, key (of the text), sig, root (the class), class_id, n_links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    table = materialize(texts.mapInArrow(lean(_members), _ROW), "jaccard-sets")
    full = table.where("sig IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    whole = full.groupBy("sig").agg(least.alias("first"), F.count("*").alias("n_docs"), *[F.first(c).alias(c) for c in ("n", "paths", "least", "sketch")])
    reps = materialize(whole.select("sig", F.col("first.doc_id").alias("doc"), F.col("first.key").alias("key"), "n_docs", "n", "paths", "least", "sketch"), "jaccard-reps")

    met, links, written = _leaves(reps)
    near = met.join(reps.select("sig", "n", "sketch", "least"), "sig").select("leaf", "sig", "n", "sketch", "at", F.when(F.col("at") >= 0, F.col("least")).alias("least")).repartition("leaf").sortWithinPartitions("leaf", "sig")
    links = materialize(_contracted(near.mapInArrow(lean(_meet), "a binary, b binary").unionByName(links)), "jaccard-links")
    release(*written)
    comps = materialize(components(links).select(F.col("node").alias("sig"), F.col("root").alias("comp")), "jaccard-components")
    release(links)

    slim = reps.select("sig", "doc", "key", "n_docs", "n")
    sized = comps.join(slim, "sig")
    blocks = sized.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    wanted = materialize(sized.join(blocks, "comp").select("comp", "blocks", "sig", "n_docs", F.col("doc").alias("__doc"), F.col("key").alias("__key")), "jaccard-wanted")
    side = F.broadcast(wanted) if fits_broadcast(wanted.count(), 96) else wanted
    found = texts.join(side, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key"))).select("comp", "blocks", "sig", "n_docs", "text")
    sets = found.mapInArrow(lean(_sets), "comp binary, blocks long, sig binary, n_docs long, tokens binary")
    own = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(other))
    grp = F.concat("comp", F.lit(":"), F.least("own", "other").cast("string").cast("binary"), F.lit("-"), F.greatest("own", "other").cast("string").cast("binary"))
    where = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    tasks = dealt.select(grp.cast("binary").alias("grp"), where.cast("int").alias("side"), "sig", "n_docs", "tokens").repartition("grp").sortWithinPartitions("grp", "side", "sig")
    compared = materialize(tasks.mapInArrow(lean(_compare), "sig binary, root binary, links long"), "jaccard-compared")
    if wanted.where("blocks > 1").isEmpty():
        classes = compared.groupBy("sig").agg(F.min("root").alias("root"))
    else:
        classes = components(compared.select(F.col("sig").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sig")
    counted = compared.groupBy("sig").agg(F.sum("links").alias("links"))
    named = counted.join(classes, "sig", "left").withColumn("root", F.coalesce("root", "sig")).join(slim.select("sig", "doc"), "sig")
    ids = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    result = slim.select("sig", "doc", "n_docs").join(named.join(ids, "root").select("sig", "root", "links", "class_id"), "sig", "left")
    by_sig = materialize(result.select(F.col("sig").alias("__sig"), F.coalesce("root", "sig").alias("root"), F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")), "jaccard-classes")
    release(reps, comps, wanted, compared)
    out = table.select("doc_id", "key", "sig").join(by_sig, F.col("sig") == F.col("__sig"), "left")
    return out.select("doc_id", "key", "sig", "root", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def join(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to a row a document: doc_id, class_id, n_links."""
    return _classes(docs).select("doc_id", "class_id", "n_links")


@shielded
def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the least by doc_id (null last), then by the text's digest. Texts without shingles stay."""
    found = materialize(_classes(docs), "jaccard-documents")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    stay = found.where("sig IS NOT NULL").groupBy("root").agg(least).select(F.col("least.doc_id").alias("__doc"), F.col("least.key").alias("__key"))
    alone = found.where("sig IS NULL").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct()
    stay = materialize(stay.unionByName(alone), "jaccard-stay")
    again = found.where("sig IS NOT NULL").groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.lit(True).alias("__again"))
    many = not again.isEmpty()
    side = stay
    if many:
        other = again.select(F.col("__doc").alias("__d"), F.col("__key").alias("__k"), "__again")
        side = stay.join(other, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left").select("__doc", "__key", "__again")
    if fits_broadcast(stay.count(), 64):
        side = F.broadcast(side)
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    kept = docs.withColumn("__digest", digest).join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__digest") == F.col("__key")))
    if many:  # of rows that repeat both, the first by their other columns
        order = Window.partitionBy("__doc", "__key").orderBy(F.xxhash64(*docs.columns))
        once = kept.where("__again").withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*docs.columns)
        return kept.where("__again IS NULL").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
