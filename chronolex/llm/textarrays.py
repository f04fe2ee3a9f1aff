"""Arrow text batches as flat numpy byte arrays: words, their places and their hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: The six ASCII white space characters that separate words: space and 0x09-0x0D.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one numpy pass handles; a longer single text is a pass of its own.
PASS_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if buffers[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts with at most ``most`` bytes together, or a single text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1), at + (rows or n))
        yield at, end
        at = end


#: Letters, digits and all bytes of non-ASCII characters: words without the punctuation around them.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, within: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and, for each text, where its words begin (n + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = within[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(max(n, 1), _MULTIPLIER, np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes in every batch."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(letters * powers(int(lengths.max()))[place], first))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A hash of the first k bytes of each word that has more than k bytes (others: zero)."""
    longer = ends - starts > k
    h = np.zeros(len(starts), np.uint64)
    table = powers(k)
    at = starts[longer]
    with np.errstate(over="ignore"):
        own = np.full(len(at), (k * 0x51ED270B7F4A7C15) & _MASK, np.uint64)
        for j in range(k):
            own += (data[at + j].astype(np.uint64) + np.uint64(1)) * table[j]
        h[longer] = mix(own)
    return h


def schema_of(df: DataFrame, column: str, **added: str) -> StructType:
    """The schema of one column of ``df`` and of columns by name and type."""
    return StructType([df.schema[column], *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items())).fields])
