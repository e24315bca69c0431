"""Sets of hashed word shingles per row of a text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.words import WORD_BASES, mix, rolling, segment_hash, signed, within_rows, words_of


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all rows, and the bounds of each row's set.

    A-Z are lower-cased. A text with fewer words than ``width`` has its whole
    sequence as its one shingle; one without words has an empty set.
    """
    words = words_of(column, lower=True)
    hashes = words.hashes()
    count = np.diff(words.first)
    valid = within_rows(words, width)
    row = words.row()[: len(valid)][valid]
    value = signed(mix(rolling(hashes, width, WORD_BASES[0])[: len(valid)][valid]))
    short = np.flatnonzero((count > 0) & (count < width))
    whole = segment_hash(hashes, words.first[short], words.first[short + 1], WORD_BASES[1])
    row = np.concatenate([row, short])
    value = np.concatenate([value, signed(mix(whole + count[short].astype(np.uint64)))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(column) + 1))


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
