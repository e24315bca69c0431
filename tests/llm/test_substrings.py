"""Passage removal against brute force."""

import hashlib

from tidemark.llm import substrings
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import documents
from tests.conftest import SMALL


def brute(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_awkward(docs, rows):
    for window, gram in ((50, 8), (20, 4)):
        got = substrings.remove_repeats(docs, window, gram).drop("intervals").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_given_tables(spark):
    got = sorted(map(tuple, QUERIES["op1_substring_dedup"](spark, SMALL).collect()), key=str)
    rows = [tuple(r) for r in documents(spark, SMALL).select("doc_id", "text").collect()]
    assert got == brute(rows, 50)


def test_intervals_are_maximal(spark):
    a, b = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(50)]
    rows = [(1, " ".join(a + b)), (2, " ".join(["x", *a, "y", *b])), (3, "x " + " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = {r.doc_id: [(c.start, c.stop) for c in r.intervals] for r in substrings.remove_repeats(docs).collect()}
    # of document 3 the x goes too: with a it starts as document 2 does
    assert cuts == {1: [], 2: [(1, 61), (62, 112)], 3: [(0, 61)]}


def test_empty(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
