"""Regression forests of one station: all trees grow together, a level at a time, on exact prefix sums.

A call sees the days of one station's block, which the calendar bounds. Samples of all trees are ordered once
a level by (tree's node, feature, rank of the value), and one running sum gives every split's gain."""

from __future__ import annotations

import numpy as np

#: Columns of a forest: a node's feature (-1: leaf), threshold, first child (the second follows it), mean; ``trees`` roots come first.
COLUMNS = ("feature", "threshold", "child", "value")
SCHEMA = "trees int, feature array<int>, threshold array<double>, child array<int>, value array<double>"


def _ranked(x: np.ndarray, max_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of a column's values (of ``max_bins`` quantiles where there are more), and the least and largest value of a rank."""
    distinct, rank = np.unique(x, return_inverse=True)
    if max_bins and len(distinct) > max_bins:
        edges = np.unique(np.quantile(x, np.arange(1, max_bins) / max_bins, method="lower"))
        of_distinct = np.searchsorted(edges, distinct, "left")
        first = np.flatnonzero(np.append(True, of_distinct[1:] != of_distinct[:-1]))
        bins = np.cumsum(np.append(0, of_distinct[1:] != of_distinct[:-1]))
        return bins[rank], distinct[first], distinct[np.append(first[1:], len(distinct)) - 1]
    return rank, distinct, distinct


#: Cells (samples by features) of a level that are ordered together; memory follows it, results don't.
CELLS = 100_000


def _splits(rank: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray, count: np.ndarray, total: np.ndarray, span: int, sums: tuple[float, float]) -> tuple[tuple[np.ndarray, ...], tuple[float, float]]:
    """Best splits of some nodes: node, place of the feature, ranks on either side, count and sum of either side. Running sums go on from ``sums``, so they don't depend on which nodes come together."""
    m = rank.shape[1]
    columns = ((node - node[0])[:, None] * m + np.arange(m)).ravel()
    key = (columns + node[0] * m) * span + rank.ravel()
    if span < 1 << 16 and columns[-1] < 1 << 16:  # NumPy orders short numbers by radix
        order = np.argsort(rank.ravel().astype(np.uint16), kind="stable")
        order = order[np.argsort(columns.astype(np.uint16)[order], kind="stable")]
    else:
        order = np.argsort(key, kind="stable")
    key, sample = key[order], order // m
    n_left, s_left = (np.cumsum(np.append(old, x[sample])) for old, x in zip(sums, (w, wy)))
    column = key // span
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    last = n_left[-1], s_left[-1]
    n_left, s_left = n_left[1:] - n_left[first][of], s_left[1:] - s_left[first][of]
    at = np.flatnonzero((column[1:] == column[:-1]) & (key[1:] != key[:-1]))  # a split lies behind these
    if not len(at):
        return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0)] * 4), last
    owner = column[at] // m
    n1, s1 = n_left[at], s_left[at]
    n2, s2 = count[owner] - n1, total[owner] - s1
    score = s1 * s1 / n1 + s2 * s2 / n2
    group = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    best = np.maximum.reduceat(score, group)
    chosen = np.flatnonzero(score == np.repeat(best, np.diff(np.append(group, len(at)))))
    chosen = chosen[np.append(True, owner[chosen][1:] != owner[chosen][:-1])]
    here = at[chosen]
    return (owner[chosen], column[here] % m, key[here] % span, key[here + 1] % span, n1[chosen], s1[chosen], n2[chosen], s2[chosen]), last


def grow(x: np.ndarray, y: np.ndarray, trees: int, features: int, seed, max_depth: int = 0, max_bins: int = 0, bootstrap: bool = True) -> dict[str, np.ndarray]:
    """``trees`` trees on ``x`` (days, features) and ``y``; a split looks at ``features`` of them. Without ``max_depth`` nodes are split until they are pure. Ties go to the first feature, then to the least threshold."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    ranked = [_ranked(x[:, j], max_bins) for j in range(width)]
    ranks, span = np.stack([r[0] for r in ranked], 1).astype(np.int64), n + 1
    begin, ends = np.cumsum([0] + [len(r[1]) for r in ranked]), [np.concatenate([r[k] for r in ranked]) for k in (1, 2)]
    weights = np.stack([np.bincount(rng.integers(n, size=n), minlength=n) for _ in range(trees)]) if bootstrap else np.ones((trees, n), np.int64)
    node, row = np.nonzero(weights)
    w = weights[node, row].astype(float)
    wy = w * y[row]
    count, total = np.bincount(node, w, trees), np.bincount(node, wy, trees)
    square = np.bincount(node, wy * y[row], trees)
    out = {"feature": [np.full(trees, -1)], "threshold": [np.zeros(trees)], "child": [np.full(trees, -1)], "value": [total / count]}
    made, level, ids = trees, 0, np.arange(trees)
    while len(ids) and (not max_depth or level < max_depth):
        impure = (square - total * total / count > 1e-12 * np.maximum(square, 1e-300)) & (count > 1)
        if not impure.all():
            local = np.cumsum(impure) - 1
            keep = impure[node]
            node, row, w, wy = local[node[keep]], row[keep], w[keep], wy[keep]
            ids, count, total = ids[impure], count[impure], total[impure]
            if not len(ids):
                break
        m = min(features, width)
        picked = np.argpartition(rng.random((len(ids), width)), m - 1, 1)[:, :m] if m < width else np.broadcast_to(np.arange(width), (len(ids), width))
        picked = np.sort(picked, 1)
        by = np.argsort(node, kind="stable")  # a node's samples together, in their order
        node, row, w, wy = node[by], row[by], w[by], wy[by]
        edges = np.searchsorted(node, np.arange(len(ids) + 1))
        cuts = np.flatnonzero(np.append(True, np.diff(edges[:-1] // max(CELLS // m, 1)) > 0))
        found, sums = [], (0.0, 0.0)
        for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
            own = slice(edges[a], edges[b])
            best, sums = _splits(ranks[row[own, None], picked[node[own]]], node[own], w[own], wy[own], count, total, span, sums)
            found.append(best)
        split, at, low, high, n1, s1, n2, s2 = (np.concatenate(x) for x in zip(*found))
        if not len(split):
            break
        feature = picked[split, at]
        below, above = ends[1][begin[feature] + low], ends[0][begin[feature] + high]
        threshold = (below + above) / 2
        threshold = np.where(threshold >= above, below, threshold)  # neighbours without a number between them
        child = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        flat = {c: np.concatenate(out[c]) for c in ("feature", "threshold", "child")}
        for c, new in (("feature", feature), ("threshold", threshold), ("child", child)):
            flat[c][ids[split]] = new
            out[c] = [flat[c], np.zeros(2 * len(split)) if c == "threshold" else np.full(2 * len(split), -1)]
        pair = lambda a, b: np.stack([a, b], 1).ravel()
        count, total = pair(n1, n2), pair(s1, s2)
        out["value"].append(total / count)
        local = np.full(len(ids), -1)
        local[split] = np.arange(len(split))
        keep = local[node] >= 0
        node, row, w, wy = local[node[keep]], row[keep], w[keep], wy[keep]
        node = 2 * node + (ranks[row, feature[node]] > low[node])
        square = np.bincount(node, wy * y[row], 2 * len(split))
        ids, level = pair(child, child + 1), level + 1
    return {"trees": trees} | {c: np.concatenate(v) for c, v in out.items()}


def predict(forest: dict, x: np.ndarray) -> np.ndarray:
    """Mean over the trees."""
    feature, threshold, child, value = (np.asarray(forest[c]) for c in COLUMNS)
    at = np.broadcast_to(np.arange(forest["trees"]), (len(x), forest["trees"])).copy()
    rows = np.broadcast_to(np.arange(len(x))[:, None], at.shape)
    while (inner := feature[at] >= 0).any():
        own = at[inner]
        at[inner] = child[own] + (x[rows[inner], feature[own]] > threshold[own])
    return value[at].mean(1)
