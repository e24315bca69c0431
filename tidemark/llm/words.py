"""Words of Arrow string columns and their hashes, vectorised over a batch.

A word is a longest run of bytes outside ``\\x20 \\x09-\\x0D``; the UTF-8 bytes
of a column are searched as one array, so no Python code runs per word. Word
hashes are polynomial in the bytes modulo 2**64, scrambled afterwards, those of
words over 256 bytes a digest of them; rolling
hashes of word windows are polynomial in the word hashes. Both come from
running sums, which makes a window hash a subtraction and a product.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: odd bases, 5 modulo 8, so that their powers have the longest period; one per independent hash
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: longer words are hashed by a digest: modulo 2**64, long words can be written that collide for every base
LONG_WORD = 256
WORD_BASES = (0xBF58476D1CE4E5BD, 0x94D049BB133111ED)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, all bits depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}
#: text bytes worked on at once; the arrays made from them stay in the processor's cache
SLICE_BYTES = 1 << 18


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is not None and len(known) >= count:
        return known[:count]
    steps = np.full(max(count, 2 * SLICE_BYTES), base, dtype=U64)
    steps[0] = 1
    table = np.cumprod(steps)
    if count <= 2 * SLICE_BYTES:  # the table of one very long text is not kept
        _POWERS[base] = table
    return table[:count]


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each segment, independent of its place."""
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64) * powers(base, len(values)), out=total[1:])
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * back[starts]


@dataclass
class Words:
    """Words of a batch: byte bounds in ``data``, and the words' bounds per row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of row i

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        size = self.ends - self.starts
        found = mix(segment_hash(self.data.astype(U64) + U64(1), self.starts, self.ends, BASES[which]) + size.astype(U64))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            own = self.data[self.starts[i] : self.ends[i]].tobytes()
            found[i] = int.from_bytes(blake2b(own, digest_size=8, person=bytes([which])).digest(), "little")
        return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low, high = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    return raw[low:high], (bounds - low if len(bounds) else np.zeros(1, np.int64))


def slices(batches, column: str = "text", size: int = SLICE_BYTES):
    """Record batches cut to about ``size`` bytes of ``column``, a row at least."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        _, bounds = text_bytes(batch.column(place))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: bytes between words, and bytes between words without punctuation
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words_of(column: pa.Array, lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    """The words of each row; with ``lower``, A-Z become a-z first."""
    data, bounds = text_bytes(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~blank[data]
    # a word starts where the byte before is blank or belongs to another row
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, dtype=U64)
    at = np.arange(len(values) - width + 1)
    return segment_hash(values, at, at + width, base)


def within_rows(words: Words, width: int) -> np.ndarray:
    """For every window of ``width`` words: whether it lies in one row."""
    n = len(words.starts) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    row = words.row()
    return row[:n] == row[width - 1 :]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
