"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer text is cut at a separator.
SLICE = 1 << 20
_random = np.random.Generator(np.random.PCG64(20240229))
#: Fixed hash constants, drawn from a fixed seed.
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_SHINGLE = _random.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Runs of other bytes than ASCII white space.
NONSPACE = ~_SPACE
#: Runs of ASCII letters and digits and of the bytes of other characters.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the start of each row's (one more at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    at, end = 0, len(data)
    while at < end:
        stop = min(at + SLICE, end)
        if stop < end:
            row = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[row] > at:
                stop = int(offsets[row])
            else:  # within one text: the next separator, or its end
                last = int(offsets[row + 1])
                while stop < last:
                    gaps = np.flatnonzero(~word[data[stop : min(stop + SLICE, last)]])
                    if len(gaps):
                        stop += int(gaps[0])
                        break
                    stop = min(stop + SLICE, last)
        yield at, stop
        at = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NONSPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the bytes: starts and ends of words, and their hashes."""
    for a, b in _slices(data, offsets, word):
        part = data[a:b]
        inside = word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        first[rows[rows < len(part)]] = True
        first &= inside
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        at = np.flatnonzero(inside)
        begin = np.searchsorted(at, starts)
        lengths = np.diff(np.append(begin, len(at)))
        place = (np.arange(len(at)) - np.repeat(begin, lengths)) & 255
        hashes = np.add.reduceat(_BYTE[part[at]] * _PLACE[place], begin)
        hashes += lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield starts + a, starts + lengths + a, mix64(hashes)


def words(texts: pa.Array, lower: bool = False, word: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of each row's first (one more at the end)."""
    if lower:
        texts = pc.utf8_lower(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    data, offsets = text_bytes(texts)
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s, _, h in word_spans(data, offsets, word):
        starts.append(s)
        hashes.append(h)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets, "left")


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within each row, sorted and distinct; a row of fewer words has one of all its words."""
    n = len(hashes)
    counts = np.diff(bounds)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the row's end
    for j in range(k):
        total += np.where(left > j, padded[j : j + n], np.uint64(0)) * _SHINGLE[j]
    total = mix64(total)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = (left >= k) | ((counts[row] < k) & (left == counts[row]))
    total, row = total[whole], row[whole]
    out, ends = [], np.zeros(len(bounds), np.int64)
    cuts = np.searchsorted(row, np.arange(len(counts) + 1))
    for r in range(len(counts)):
        own = total[cuts[r] : cuts[r + 1]]
        if len(own) > 1:
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        ends[r + 1] = ends[r] + len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), ends
