"""Column expressions and byte-level helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, JVM-side."""
    for other in SPACE_CHARS[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_count(text: Column) -> Column:
    """Number of words."""
    return F.size(words_of(text)).cast("long")


# --- bytes of many texts at once ------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_draw = np.random.Generator(np.random.PCG64(20240))
#: Two random odd multipliers and byte values of the rolling hashes.
BASES = (_draw.integers(1 << 62, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
VALUES = (_draw.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Roller:
    """Rolling hashes over sequences of 64-bit values; equal slices get equal hashes."""

    def __init__(self, which: int):
        self.base = int(BASES[which])
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        """Powers of the base and of its inverse modulo 2^64, up to n."""
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.reach(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever the slice stands."""
        h = (prefix[end] - prefix[start]) * self.down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and the offsets of its rows; null is empty."""
    import pyarrow as pa

    column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    column = column.cast(pa.large_binary()).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges whose bytes stay below ``most``; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (with one more at the end)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid
    end = end.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)
