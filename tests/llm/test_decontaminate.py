"""Leaks against all alignments, with the benchmark broadcast and joined; coverage of the masks."""

import itertools
import re

import pytest

from tests.conftest import SMALL
from tidemark.llm import decontaminate as D
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import documents, table

LOWER = {c: c + 32 for c in range(65, 91)}
TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    by_id = {}
    for i, t in items:
        by_id.setdefault(i, []).append(tokens(t))
    for d, text in docs:
        own = tokens(text)
        for i, shapes in by_id.items():
            best = None
            for item in shapes:
                best = min(filter(None, [best, best_alignment(own, item)]), default=None)
            if best:
                out.append((d, i, best[1], best[2], -best[0], best[3]))
    return sorted(out, key=str)


def best_alignment(own, item):
    width, least = min(len(item), 13), len(item) if len(item) < 8 else min(len(item), 13) - (2 if len(item) >= 13 else 1)
    best = None
    for diagonal in range(width - len(item), len(own) - width + 1) if item else ():
        low, high = max(0, -diagonal), min(len(item), len(own) - diagonal)
        equal = [own[k + diagonal] == item[k] for k in range(low, high)]
        good = [k for k in range(len(equal) - width + 1) if sum(equal[k : k + width]) >= least]
        if good:
            a, b = good[0], good[-1] + width
            now = (-sum(equal[a:b]), low + diagonal + a, low + diagonal + b, len(item))
            best = now if best is None else min(best, now)
    return best


def test_masks_hit_every_stretch_with_two_substitutions():
    for changed in itertools.combinations(range(D.STRETCH), D.DIFFER):
        assert any(
            all(at + place not in changed for place in mask)
            for mask in D.MASKS
            for at in range(D.STRETCH - mask[-1])
        ), changed


@pytest.fixture(scope="module")
def planted(spark, rows):
    passage = next(t for i, t in rows if i == 111).split()
    changed = [*passage[:20]]
    changed[5], changed[11] = "xx", "yy"
    three = [*changed]
    three[8] = "zz"
    short = [f"s{i}" for i in range(9)]
    items = [(1, " ".join(passage[:30])), (2, " ".join(passage[40:53]) + "."), (3, " ".join(short)), (4, "too short"), (5, None), (None, " ".join(passage[30:60])), (6, "")]
    # items that repeat, ids with two texts, a head that many items share, and short items
    items += [(1, " ".join(passage[:30])), (2, " ".join(passage[41:60])), (7, " ".join(short)), (7, " ".join(passage[:14])), (8, "s3 s4"), (9, "s2"), (None, "s1")]
    items += [(20 + i, " ".join([*passage[:20], f"q{i}", *passage[20 + i : 30]])) for i in range(12)] + [(40, " ".join(passage[12:18])), (41, " ".join([*passage[12:17], "no"]))]
    more = [(900, f"Before, {' '.join(changed)} after"), (901, " ".join(three[2:15])), (902, f"a b {' '.join(short).upper()}!"), (903, " ".join([*short[:4], "x", *short[5:]])), (904, " ".join(["x", *short[1:8], "y"]))]
    more += [(905, "s3 s4 s3 s4 s2"), (905, "s3 s4 s3 s4 s2"), (905, "s2"), (None, "s2 s1 s1")]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    return [(i, t) for i, t in rows if i is None or i < 100 or i >= 110] + more, items, bench


@pytest.mark.parametrize("most", [D.BROADCAST_SEEDS, 0])
def test_planted(spark, planted, most):
    docs, items, bench = planted
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, D.find_leaks(frame, bench, most).collect()), key=str)
    assert got == brute(docs, items)
    assert {900, 902, 903} <= {g[0] for g in got} and (904, 3) not in {g[:2] for g in got}
    assert {(900, 40), (905, 8), (905, 9)} <= {g[:2] for g in got} and (900, 41) not in {g[:2] for g in got}


def test_given_tables(spark):
    got = sorted(map(tuple, QUERIES["op9_decontaminate"](spark, SMALL).collect()), key=str)
    docs = [tuple(r) for r in documents(spark, SMALL).select("doc_id", "text").collect()]
    short = [d for d in docs if len(d[1]) < 3000]
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    keep = {d[0] for d in short}
    assert [g for g in got if g[0] in keep] == brute(short, items)


def test_empty(docs, no_docs, planted):
    assert D.find_leaks(no_docs, planted[2]).count() == 0
    assert D.find_leaks(docs, planted[2].limit(0)).count() == 0
