"""Binary fuse filters: static approximate sets of 64-bit keys, at about nine bits a key."""

from __future__ import annotations

import math

import numpy as np

from .words import mixed

_HEADER = 4
_MAX_SEEDS = 100


def _shape(keys: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for the first of three places."""
    length = 1 << max(2, min(18, int(math.floor(math.log(max(keys, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(keys, 2)))
    segments = max(1, -(-int(round(keys * factor)) // length) - 2)
    return length, segments


def _places(hashes: np.ndarray, length: int, segments: int) -> np.ndarray:
    low = ((hashes >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    first = low.astype(np.int64)
    second = (low + np.uint64(length)) ^ ((hashes >> np.uint64(18)) & mask)
    third = (low + np.uint64(2 * length)) ^ (hashes & mask)
    return np.stack([first, second.astype(np.int64), third.astype(np.int64)])


def _marks(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of ``keys`` (signed or unsigned 64-bit, repeats allowed, possibly none)."""
    keys = np.unique(keys.astype(np.int64).view(np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(_MAX_SEEDS):
        hashes = mixed(keys + mixed(np.array([seed + 1], np.uint64)))
        places = _places(hashes, length, segments)
        order = _peel(places, size)
        if order is not None:
            table = np.zeros(size, np.uint8)
            marks = _marks(hashes)
            for peeled, at in reversed(order):
                rest = table[places[0][peeled]] ^ table[places[1][peeled]] ^ table[places[2][peeled]]
                table[at] = marks[peeled] ^ rest ^ table[at]
            return np.array([seed, length, segments, len(keys)], np.int64).tobytes() + table.tobytes()
    raise RuntimeError("no seed gives a filter")  # each seed fails with a chance of a few per cent at most


def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the place each one has alone), or None if some keys remain."""
    n = places.shape[1]
    counts = np.bincount(places.ravel(), minlength=size)
    sums = np.zeros(size, np.int64)
    numbers = np.arange(n)
    for row in places:
        np.bitwise_xor.at(sums, row, numbers)
    left, order = n, []
    alone = np.flatnonzero(counts == 1)
    while len(alone):
        peeled, first = np.unique(sums[alone], return_index=True)
        order.append((peeled, alone[first]))
        left -= len(peeled)
        touched = places[:, peeled]
        for row in touched:
            np.subtract.at(counts, row, 1)
            np.bitwise_xor.at(sums, row, peeled)
        touched = np.unique(touched)
        alone = touched[counts[touched] == 1]
    return None if left else order


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: always true for its keys, for others once in about 256 cases."""
    seed, length, segments, n = np.frombuffer(data, np.int64, _HEADER).tolist()
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(data, np.uint8, offset=8 * _HEADER)
    hashes = mixed(keys.astype(np.int64).view(np.uint64) + mixed(np.array([seed + 1], np.uint64)))
    first, second, third = _places(hashes, length, segments)
    return _marks(hashes) == table[first] ^ table[second] ^ table[third]
