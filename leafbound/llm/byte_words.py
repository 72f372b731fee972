"""Words of many texts at once: a table of byte classes finds their ends in the joined UTF-8 buffer, xxhash groups them.

Nothing here decodes a text. Bytes from 0x80 on belong to letters beyond ASCII, so a class per byte is enough for
words that are defined by ASCII separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts, of `most` bytes or a single text each: first row, row after the last, lower-cased bytes, and where each text starts and the last ends."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to, LOWER[data[ends[at] : ends[to]]], ends[at : to + 1] - ends[at]
        at = to


def cut(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: runs of bytes of which the table `inside` is true; none goes on over an edge of two texts."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    starts, ends = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    inner = edges[(edges > 0) & (edges < len(data))]
    starts[inner] |= mask[inner + 1]
    ends[inner - 1] |= mask[inner]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def group(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the number of its group of equal words; of each group its first word and its 64-bit hash.

    Words of one hash are compared byte by byte with the first of them; those that differ make groups of their own.
    """
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    keys, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(starts):
        return ids, first, keys
    same = ends - starts == (ends - starts)[first[ids]]
    some = np.flatnonzero(same)
    sizes = (ends - starts)[some]
    before = np.cumsum(sizes) - sizes
    step = np.arange(sizes.sum()) - np.repeat(before, sizes)
    equal = data[step + np.repeat(starts[some], sizes)] == data[step + np.repeat(starts[first[ids[some]]], sizes)]
    same[some] = np.logical_and.reduceat(equal, before)
    for i in np.flatnonzero(~same):  # two words of one hash
        twin = next((g for g in range(len(first)) if raw[starts[first[g]] : ends[first[g]]] == raw[starts[i] : ends[i]]), None)
        if twin is None:
            twin, first, keys = len(first), np.append(first, i), np.append(keys, hashes[i])
        ids[i] = twin
    return ids, first, keys


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> list[bytes]:
    """The bytes of the given words."""
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
