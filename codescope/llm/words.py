"""Words, word hashes and shingle hashes of whole Arrow text columns, computed with numpy in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a row that is longer is handled alone, in pieces cut at separators.
BLOCK = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def separator_table(more: bytes = b"") -> np.ndarray:
    """True for the bytes that part words: space, 0x09 to 0x0D, and ``more``."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E), *more]] = True
    return table


SPACES = separator_table()
ASCII_PUNCTUATION = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
SPACES_AND_PUNCTUATION = separator_table(ASCII_PUNCTUATION)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from zero) and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``; a word ends at a separator or with its row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values *= _MIX_A
    values ^= values >> np.uint64(27)
    values *= _MIX_B
    values ^= values >> np.uint64(31)
    return values


class WordHasher:
    """64-bit hashes of the words of text columns: a polynomial in the bytes from prefix sums, then mixed."""

    def __init__(self, separators: np.ndarray = SPACES):
        self.separators = separators
        self._powers = self._inverses = np.zeros(0, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self._powers) < size:
            size = max(size, BLOCK)
            step = np.full(size, _STEP, np.uint64)
            back = np.full(size, pow(int(_STEP), -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self._powers, self._inverses = np.cumprod(step), np.cumprod(back)

    def _hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = word_bounds(data, offsets, self.separators)
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self._inverses[starts]
        return starts, mixed(raw + (ends - starts).astype(np.uint64) * _MIX_A)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of one row that is longer than a block, piece by piece."""
        found, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data):
                gaps = np.flatnonzero(self.separators[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(end + BLOCK, len(data))  # one word that is longer than a block
            piece = data[at:end]
            found.append(self._hashes(piece, np.array([0, len(piece)]))[1])
            at = end
        return np.concatenate(found)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, number of words of each row, word hashes) for successive ranges of whole rows."""
        offsets, data = text_buffers(column)
        for first, last in blocks(offsets):
            part = data[offsets[first] : offsets[last]]
            if last == first + 1 and len(part) > BLOCK:
                hashes = self._long(part)
                yield first, np.array([len(hashes)]), hashes
                continue
            inner = offsets[first : last + 1] - offsets[first]
            starts, hashes = self._hashes(part, inner)
            yield first, np.diff(np.searchsorted(starts, inner, side="left")), hashes


def shingle_hashes(counts: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row with fewer words has one shingle of all of them."""
    rows = np.repeat(np.arange(len(counts)), counts)
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    found_rows, found = [], []
    if len(hashes) >= size:
        whole = rows[: len(rows) - size + 1] == rows[size - 1 :]
        total = sum(hashes[i : len(hashes) - size + 1 + i] * weights[i] for i in range(size))
        found_rows.append(rows[: len(whole)][whole])
        found.append(mixed(total[whole]))
    short = (counts > 0) & (counts < size)
    if short.any():
        begins = np.cumsum(counts) - counts
        total = np.zeros(int(short.sum()), np.uint64)
        for i in range(size - 1):
            there = counts[short] > i
            total[there] += hashes[begins[short][there] + i] * weights[i]
        found_rows.append(np.flatnonzero(short))
        found.append(mixed(total + counts[short].astype(np.uint64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_rows), np.concatenate(found)
