"""Token files and packing: exact round trips against the tokenizer itself."""

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import MEDIUM
from tidemark.llm import packing, token_files
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import documents
from tidemark.llm.token_ids import encoder
from tidemark.session import scratch_path

MIXED = st.text(alphabet="ab. ,!\n\t1'sé́ 　—²ß", max_size=30)
WORDS = st.lists(st.sampled_from(["it's", "word,", "Foo.", "\nBar", "x***", "l'été", "a1", "—", "<|endoftext|>", "#"]), max_size=8).map(" ".join)


@pytest.mark.parametrize(("path", "spaces"), [(token_files.byte_bpe(), True), (packing.word_bpe(), False)])
def test_ids_are_the_tokenizers_own(path, spaces):
    own = encoder(path, "I", spaces)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(MIXED, WORDS), max_size=4))
    def check(texts):
        plain = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [array("I", x).tolist() for x in own.ids(texts)] == plain

    check()


def expected_ids(path, rows, end):
    own = encoder(path, "I", True).tokenizer
    return [(i, t, [*own.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_files(spark, got, rows):
    lengths = defaultdict(list)
    for i, _, ids in expected_ids(token_files.byte_bpe(), rows, 2):
        lengths[i].append((len(ids), crc(ids)))
    found, at = defaultdict(list), 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in lengths.items()}


def test_files_awkward(spark, docs, rows, no_docs):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, token_files.Layout(token_files.byte_bpe()))
    check_files(spark, token_files.read_digests(spark, path).collect(), rows)
    two = token_files.read_document(spark, path, 110)
    blocks = spark.read.parquet(f"{path}/blocks")
    for row in blocks.select("least", "greatest", "doc_ids").collect():
        known = [i for i in row.doc_ids if i is not None]
        assert (row.least, row.greatest) == ((min(known), max(known)) if known else (None, None))
    assert sorted(two) == sorted(ids for i, _, ids in expected_ids(token_files.byte_bpe(), [x for x in rows if x[0] == 110], 2))
    assert token_files.read_document(spark, path, -5) == []
    empty = scratch_path(spark, "tokens")
    token_files.write_tokens(no_docs, empty, token_files.Layout(token_files.byte_bpe()))
    assert token_files.read_digests(spark, empty).count() == 0


def test_other_dictionary_is_refused():
    row = {"dictionary": token_files.dictionary_hash(b"one"), "frames": b"", "offsets": [0], "n_tokens": []}
    with pytest.raises(ValueError, match="another dictionary"):
        list(token_files.open_frames(row, b"two", []))


def test_files_given_tables(spark):
    rows = [tuple(r) for r in documents(spark, MEDIUM).select("doc_id", "text").collect()]
    check_files(spark, QUERIES["op8_token_files"](spark, MEDIUM).collect(), rows)


def check_pieces(got, rows, most_open):
    own = encoder(packing.word_bpe(), "I", False).tokenizer
    texts = defaultdict(list)
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        texts[i].append(ids)
    assert sum(r.length for r in got) == sum(len(x) for v in texts.values() for x in v)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in ((i, v[0]) for i, v in texts.items() if len(v) == 1):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    full = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.SEQUENCE
        full += at == packing.SEQUENCE
    assert len(by_sequence) - full <= most_open


def test_packing_awkward(docs, rows, no_docs):
    check_pieces(packing.pack_documents(docs, packing.word_bpe()).collect(), rows, 8)
    assert packing.pack_documents(no_docs, packing.word_bpe()).count() == 0


def test_packing_given_tables(spark):
    rows = [tuple(r) for r in documents(spark, MEDIUM).select("doc_id", "text").collect()]
    check_pieces(QUERIES["op6_packing"](spark, MEDIUM).collect(), rows, 8)


def test_packed_neighbours_are_like_each_other(spark):
    """Along all sequences, over the borders of tasks as well, neighbours are nearer than chance."""
    rows = [tuple(r) for r in documents(spark, MEDIUM).select("doc_id", "text").collect()]
    pieces = packing.pack_documents(documents(spark, MEDIUM), packing.word_bpe()).collect()
    order = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert len(order) == len(rows) and len({r.sequence_id for r in pieces}) > 8
    vectors = dict(zip([i for i, _ in rows], packing.vectors(pa.array([t for _, t in rows])), strict=True))
    along = np.array([vectors[i] for i in order])
    near = np.sqrt(((along[1:] - along[:-1]) ** 2).sum(axis=1))
    mixed = np.random.default_rng(1).permutation(len(along))
    chance = np.sqrt(((along[mixed][1:] - along[mixed][:-1]) ** 2).sum(axis=1))
    assert np.median(near) < 0.4 * np.median(chance)
    # the places themselves ascend through all tasks
    places = dict(zip([i for i, _ in rows], packing.order_of(pa.array([t for _, t in rows]), pa.array([0] * len(rows))), strict=True))
    ascent = np.array([places[i] for i in order])
    assert (np.diff(ascent) >= 0).all()


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    key = packing.hilbert_key(points, bits)
    assert sorted(key.tolist()) == list(range(len(points)))
    assert np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_like_texts_lie_close():
    a, b = "the of and to in " * 40, "der die und von zu " * 40
    v = packing.vectors(pa.array([a, a + "with", b, None]))
    assert np.abs(v[0] - v[1]).sum() < np.abs(v[0] - v[2]).sum() and not v[3].any()
