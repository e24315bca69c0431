"""Vectorised words and rolling hashes against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.words import NOT_ALNUM, WORD_BASES, rolling, slices, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b. ß", max_size=20)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    words = words_of(pa.array(texts, pa.string()))
    plain = [(t or "").encode().split() for t in texts]
    assert np.diff(words.first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)] == flat
    seen = {}
    for word, h in zip(flat, words.hashes().tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lower_and_punctuation():
    words = words_of(pa.array(["It's É-x, THE end."]), lower=True, blank=NOT_ALNUM)
    assert [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)] == ["it", "s", "É", "x", "the", "end"]


def test_rolling_depends_on_the_window_only():
    values = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], dtype=np.uint64)
    h = rolling(values, 3, WORD_BASES[0])
    assert h[0] == h[3] and len(set(h.tolist())) == 6
    assert len(rolling(values[:2], 3, WORD_BASES[0])) == 0


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    parts = list(slices([batch], size=12))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1
