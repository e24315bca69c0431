"""The audit against a walk through every order, document by document."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from tidemark.llm.filter_audit import LETTERS, audit, lehmer_rank, removal_intervals


def failed(text, copy):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    got = [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search("[#$%&*|]", text)),
        copy,
    ]
    return {x for x, f in zip(LETTERS, got, strict=True) if f}


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = []
    for i, text, lang in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in rows)
        seen.append((i, lang or "", failed(text or "", copy)))
    out = {}
    for part in {p for _, p, _ in seen}:
        own = [(i, f) for i, p, f in seen if p == part]
        total = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = own
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(here)
                out[part, "".join(order), step] = [
                    len(left),
                    len(here),
                    sum(x in f for _, f in own) - len(here),
                    sum(f == {x} for _, f in own),
                    sum(i in good for i, _ in here),
                    sum(i in toxic for i, _ in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def result(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in cols] for r in df.collect()}


def test_ranks_and_intervals():
    for rank, order in enumerate(permutations(LETTERS)):
        assert lehmer_rank("".join(order)) == rank
    orders = ["".join(o) for o in permutations(LETTERS)]
    found = {}
    for mask, step, low, high in removal_intervals():
        for rank in range(low, high):
            assert (mask, rank) not in found
            found[mask, rank] = step
    for mask in range(1, 32):
        inside = {x for i, x in enumerate(LETTERS) if mask >> i & 1}
        for rank, order in enumerate(orders):
            assert found[mask, rank] == next(s for s, x in enumerate(order, 1) if x in inside)


def test_awkward(spark, docs, rows):
    more = [(500, "UPPER CASE " * 70, "de"), (501, "UPPER CASE " * 70, None), (502, "50 % of # it", "de"), (502, "UPPER CASE " * 70, "fr")]
    more += [(510 + i, " ".join(f"word{k}" for k in range(120)) + " $" * (i % 2), "de") for i in range(8)]
    full = [(i, t, "en") for i, t in rows] + more
    labels = [(i, i % 2, i % 3 % 2) for i in range(1, 600, 2)] + [(None, 1, 1), (500, 0, 0), (500, 1, None), (10, None, None), (9999, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    own = spark.createDataFrame([(i, t, "en") for i, t in rows] + more, "doc_id long, text string, lang string")
    wide = own.selectExpr("*", "'a' AS mask", "'b' AS step", "'c' AS docs", "1 AS part", "2 AS same", "3 AS rank", "4 AS q").repartition(7)
    got = result(audit(wide, told))
    assert got == brute(full, labels)
    # the fixture's own extra columns clash as well
    assert result(audit(docs, told)) == brute([(i, t, "en") for i, t in rows], labels)


def test_empty(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(no_docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    assert result(audit(one, labels)) == brute([(None, None, None)], [])
