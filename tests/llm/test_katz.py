"""The model against one made of dictionaries, and its sums against 1."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import katz
from tidemark.llm.labelled import held_out
from tidemark.llm.tables import documents


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["</s>"]


def discounts(counts):
    n = Counter(counts)
    for cut in range(5, 0, -1):
        if all(n[r] for r in range(1, cut + 1)):
            a = (cut + 1) * n[cut + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else 2 for r in range(1, cut + 1)}
            if all(0 < x < 1 for x in d.values()):
                return d
    return {1: 0.5}


class Brute:
    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            before = "<s>"
            for w in tokens(text):
                self.one[w] += 1
                self.two[before][w] += 1
                before = w
        self.n = sum(self.one.values())
        self.d1, self.d2 = discounts(self.one.values()), discounts(c for f in self.two.values() for c in f.values())
        held = sum(self.d1.get(c, 1) * c for c in self.one.values())
        plain = all(c not in self.d1 for c in self.one.values())
        self.total = self.n + plain
        self.unknown = (self.total - held) / self.total if self.n else 1.0

    def word(self, w):
        c = self.one[w]
        return self.d1.get(c, 1) * c / self.total if c else self.unknown

    def after(self, u, w):
        f = self.two.get(u)
        if not f:
            return self.word(w)
        total = sum(f.values()) + all(c not in self.d2 for c in f.values())
        if w in f:
            return self.d2.get(f[w], 1) * f[w] / total
        left = 1 - sum(self.d2.get(c, 1) * c / total for c in f.values())
        return left / (1 - sum(self.word(x) for x in f)) * self.word(w)

    def row(self, text):
        ts = tokens(text)
        base = sum(math.log10((self.one[w] + 0.1) / (self.n + 0.1 * (len(self.one) + 1))) for w in ts)
        score = sum(math.log10(self.after(u, w)) for u, w in zip(["<s>", *ts], ts, strict=False))
        return len(ts), sum(self.one[w] > 0 for w in ts), self.n, base, score


def check(df, rows, held=lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0):
    model = Brute([t for i, t in rows if not held(i)])
    want = sorted(((i is None, i or 0), held(i), *model.row(t)) for i, t in rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-7)
    return model


@pytest.mark.parametrize("block", [1 << 24, 20_000])
def test_awkward(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    monkeypatch.setattr(katz, "SAMPLE_BYTES", block // 8)
    model = check(katz.katz_scores(docs, held_out(10, 0)), rows)
    # all words and the unknown one have probability 1 after any context
    for u in ["<s>", *list(model.two)[:40], "never there"]:
        assert abs(sum(model.after(u, w) for w in [*model.one, "never there"]) - 1) < 1e-9


def test_given_table(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 60_000)
    own = documents(spark, SMALL)
    check(katz.op13_katz(spark, SMALL), [tuple(r) for r in own.select("doc_id", "text").collect()])


def test_few(spark, docs, no_docs, rows):
    assert katz.katz_scores(no_docs, held_out(10, 0)).count() == 0
    # nothing to learn from
    got = katz.katz_scores(docs, F.lit(True)).collect()
    assert len(got) == len(rows) and {(r.train_tokens, r.n_known, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    # no count is discounted; a context that only held-out rows have
    same = [(i, "a b a b") for i in range(1, 40)] + [(1000 + i, "a c b x b") for i in range(60)]
    table = spark.createDataFrame(same, "doc_id long, text string")
    check(katz.katz_scores(table, F.col("doc_id") >= 1000), same, lambda i: i >= 1000)


def test_discounts():
    seen = [100, 40, 20, 12, 8, 6]
    d = katz.Discounts.good_turing(seen)
    assert d.cut == 5
    counts = [r for r, n in enumerate(seen, 1) for _ in range(n)]
    assert np.allclose(d.factor[1:], list(discounts(counts).values()))
    # Katz's condition: what is taken off is the Good-Turing mass of the unseen
    assert abs(d.taken(seen) - seen[0]) < 1e-9
    assert katz.Discounts.good_turing([0] * 6).factor.tolist() == [1.0, 0.5]
