"""Components against all pairs, also where every list is hot and blocks are small."""

import random

import pytest

from tests.conftest import SMALL
from tidemark.llm import neardup
from tidemark.llm.components import connected_components
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import documents

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = (text or "").translate(LOWER).encode().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, similarity=80):
    nodes = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in nodes if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in nodes if i is not None and s]
    for k, (i, a) in enumerate(named):
        for j, b in named[:k]:
            if 100 * len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, s in nodes:
        top = None if i is None else find(i)
        out.append((i, len(s), top, i == top))
    return sorted(out, key=str)


@pytest.mark.parametrize(("longest", "block"), [(60, 1000), (2, 7)])
def test_awkward(docs, rows, monkeypatch, longest, block):
    monkeypatch.setattr(neardup, "LIST", longest)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    got = neardup.near_duplicates(docs, 4, 80).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def families(r):
    """A large family of near copies, a smaller one, and texts that only share a long passage with all of them."""
    passage = [f"p{i}" for i in range(60)]
    rows, at = [], 0
    for size, words in ((300, 70), (40, 70), (60, None)):
        base = [f"f{at}w{i}" for i in range(words or 0)]
        for _ in range(size):
            own = list(base) if words else [f"o{r.randrange(10**9)}" for _ in range(r.randrange(40, 90))]
            for _ in range(r.randrange(4) if words else 0):
                own[r.randrange(len(own))] = f"x{r.randrange(10**9)}"
            rows.append((at, " ".join(passage + own)))
            at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [12, 100, 1000])
def test_families_in_many_blocks(spark, monkeypatch, block):
    rows = families(random.Random(9))
    monkeypatch.setattr(neardup, "LIST", 20)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    monkeypatch.setattr(neardup, "HUB", 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, neardup.near_duplicates(frame, 4, 80).collect()), key=str) == brute(rows, 4)


def shuffled_rows(spark, monkeypatch, size):
    """How many rows meet, for a family of ``size`` near copies."""
    r, seen = random.Random(2), []
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(size):
        own = list(base)
        own[r.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    meet = neardup.met_links

    def counted(meetings, sets, similarity):
        seen.append(meetings.count())
        return meet(meetings, sets, similarity)

    monkeypatch.setattr(neardup, "met_links", counted)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neardup, "HUB", 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert neardup.near_duplicates(frame, 4, 80).select("component_id").distinct().count() == 1
    monkeypatch.setattr(neardup, "met_links", meet)
    return sum(seen)


def test_what_meets_grows_with_a_family_not_with_its_square(spark, monkeypatch):
    small, large = (shuffled_rows(spark, monkeypatch, n) for n in (2000, 4000))
    assert small > 2000 and large < 2.3 * small


def test_given_tables(spark):
    got = QUERIES["op7_minhash"](spark, SMALL).collect()
    rows = [tuple(r) for r in documents(spark, SMALL).select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_five_words_and_empty(docs, rows, no_docs):
    got = neardup.near_duplicates(docs, 5, 80).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5)
    assert neardup.near_duplicates(no_docs, 5, 80).count() == 0


def test_one_id_with_two_texts(spark, monkeypatch):
    """A near copy of either text of an id belongs to it, through short and hot lists."""
    r = random.Random(3)
    one, two = [[f"{c}{r.randrange(10**6)}" for _ in range(90)] for c in "ab"]
    near = lambda words, k: " ".join([*words[:k], "new", *words[k + 1 :]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, near(one, 30)), (7, near(two, 40)), (8, " ".join(two)), (4, near(two, 85)), (9, "other words here and there")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for longest in (60, 1):
        monkeypatch.setattr(neardup, "LIST", longest)
        assert sorted(map(tuple, neardup.near_duplicates(frame, 4, 80).collect()), key=str) == brute(rows, 4)


def test_other_similarities(spark):
    """Two of six words changed leave half of the shingles; the sketch follows the similarity asked for."""
    assert (neardup.least_shared(80), neardup.hot_keys(80)) == (8, 10)
    with pytest.raises(ValueError, match="no links"):
        neardup.least_shared(40)
    r = random.Random(8)
    rows = [(1, "a b c d e f"), (2, "a b c d x y"), (3, "a b z q x y")]
    for i in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 60))]
        rows += [(100 + 10 * i + k, " ".join(w if r.random() > 0.06 * k else "n" for w in base)) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for width, similarity in ((1, 50), (2, 60), (3, 95), (2, 100)):
        got = neardup.near_duplicates(frame, width, similarity).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, width, similarity)


def test_long_words_that_a_polynomial_confuses(spark):
    """Two words of 2048 letters with equal polynomials modulo 2**64 for every odd base."""
    order = "0"
    while len(order) < 2048:
        order += order.translate({48: 49, 49: 48})
    rows = [(1, order.replace("0", "a").replace("1", "b")), (2, order.replace("0", "b").replace("1", "a"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(frame, 4, 80).collect())) == brute(rows, 4)


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (7, 7)]
    r.shuffle(chain)
    links = spark.createDataFrame([(a, b) if r.random() < 0.5 else (b, a) for a, b in chain], "u long, v long")
    got = {x.node: x.component for x in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert connected_components(links.limit(0)).count() == 0
