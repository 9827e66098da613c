"""Texts of Arrow batches as flat numpy arrays: slices of bounded size, words, shingles, character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once (up to some 55 bytes of memory a byte of text); a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_POWERS: dict[str, np.ndarray] = {}
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_STEP = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts that hold about ``limit`` bytes; nulls are empty."""
    for piece in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_large_string(piece.type):
            kind = np.int64
        else:
            piece, kind = piece.cast(pa.string()), np.int32
        _, off, data = piece.buffers()
        offsets = np.frombuffer(off, kind)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        if piece.null_count:
            lengths = np.where(np.asarray(piece.is_valid()), lengths, 0)
        first = 0
        while first < len(piece):
            ends = np.cumsum(lengths[first:])
            last = first + max(1, int(np.searchsorted(ends, limit, side="right")))
            own = np.concatenate([[0], np.cumsum(lengths[first:last])])
            if lengths[first:last].sum() == offsets[last] - offsets[first]:
                data = raw[offsets[first] : offsets[last]]
            else:
                data = np.concatenate([raw[offsets[i] : offsets[i] + lengths[i]] for i in range(first, last)])
            yield first, last, data, own
            first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for longer words than a slice are not kept."""
    usual = SLICE_BYTES + (1 << 16)
    if n > usual:
        return _steps(n, _P), _steps(n, _P_INV)
    if not _POWERS:
        _POWERS.update(up=_steps(usual, _P), down=_steps(usual, _P_INV))
    return _POWERS["up"], _POWERS["down"]


def _steps(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts (A-Z as a-z, unless told not to), and each text's first word: (hashes, bounds)."""
    low = _LOWER[data] if lower else data
    solid = ~_SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of whole words: powers and sums stay small for very long texts
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
        base = int(starts[at])
        part = low[base : int(ends[stop - 1])]
        up, down = _powers(len(part))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        hashes[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; a text with fewer words is one shingle, one without is none."""
    words, bounds = word_hashes(data, offsets)
    n = len(words)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        runs += words[j : n - k + 1 + j] * _STEP[j]
    runs = mix64(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            own = words[a:b] * _STEP[: b - a]
            out.append(mix64(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
