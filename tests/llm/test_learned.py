"""The learned operators: held-out accuracy, exact base counts, awkward rows, gradients."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import MEDIUM, SMALL
from tidemark.llm import isolation, pii, quality_cnn, toxicity
from tidemark.llm.labelled import best_cut
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import documents, table

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labels(spark, rows):
    found = [(i, int(i % 2), int(i % 3 == 0), "own") for i, _ in rows if i is not None] + [(None, 1, 1, "own"), (200, None, None, "own")]
    return spark.createDataFrame(found, LABELS)


def folds(found, modulo, rest):
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % modulo == rest)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def accuracy(spark, name, label, sf):
    truth = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    found = QUERIES[name](spark, sf).collect()
    assert len(found) == documents(spark, sf).count()
    held = [(truth[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in truth]
    return found, np.mean([a == b for a, b in held])


def test_quality_given_tables(spark):
    found, right = accuracy(spark, "op10_quality_cnn", "quality", MEDIUM)
    folds(found, 4, 2)
    assert right > 0.9


def test_toxicity_given_tables(spark):
    found, right = accuracy(spark, "op3_toxicity", "toxic", MEDIUM)
    folds(found, 3, 1)
    assert right > 0.9


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_scores_awkward(which, docs, rows, no_docs, labels, monkeypatch):
    monkeypatch.setattr(quality_cnn, "EPOCHS", 1)
    monkeypatch.setattr(quality_cnn, "LEAST_STEPS", 1)
    train, score = {
        "quality": (quality_cnn.train, quality_cnn.quality_scores),
        "toxicity": (toxicity.train, toxicity.toxicity_scores),
    }[which]
    for known in (labels, labels.limit(0)):
        found = score(docs, train(docs, known)).collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
        folds(found, *{"quality": (4, 2), "toxicity": (3, 1)}[which])
    assert score(no_docs, train(no_docs, labels)).count() == 0


def test_network_gradients():
    texts, y = pa.array(["spam spam spam", "", "a fine text, quite long" * 30, "short"]), np.array([0, 1, 1, 0])
    random = np.random.default_rng(0)
    net = quality_cnn.Network(
        random.normal(0, 0.5, (256, quality_cnn.EMBED)),
        random.normal(0, 0.3, (quality_cnn.WIDTH, quality_cnn.EMBED, quality_cnn.FILTERS)),
        random.normal(0, 0.1, quality_cnn.FILTERS),
        random.normal(0, 0.3, 2 * quality_cnn.FILTERS + 1),
    )

    def loss():
        p = 1 / (1 + np.exp(-net.logits(texts, net.tables())))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in zip(("embed", "filters", "bias", "out"), net.gradients(texts, y), strict=True):
        value = getattr(net, name)
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = value[spot]
        value[spot] = kept + 1e-3
        up = loss()
        value[spot] = kept - 1e-3
        down = loss()
        value[spot] = kept
        assert np.isclose((up - down) / 2e-3, grad[spot], rtol=0.05, atol=1e-4), name


def test_network_sees_the_whole_text():
    good, bad = ["plain words here " * 20] * 40, ["plain words here " * 20 + "###$$$###" * 5] * 40
    net = quality_cnn.fit(pa.array(good + bad), np.array([1] * 40 + [0] * 40), epochs=8, least_steps=60)
    long = "plain words here " * 3000
    score = net.scores(pa.array([long, long + "###$$$###" * 5]), net.tables())
    assert score[1] < score[0]


def test_best_cut():
    assert 2 < best_cut(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1])) < 3
    assert best_cut(np.array([1.0, 2.0]), np.array([1, 1])) < 1


def test_clause_machine():
    neg, say, aim, menace = toxicity.NEG, toxicity.SAY, toxicity.AIM, toxicity.MENACE
    plain = toxicity.run_clause([0, 5.0], [0, 0])
    assert plain == (5.0, 1, 0, 0, 0)
    assert toxicity.run_clause([0, 5.0], [neg, 0])[0] == 5 * toxicity.NEGATED
    assert toxicity.run_clause([0, 0, 0, 0, 5.0], [neg, 0, 0, 0, 0])[0] == 5
    assert toxicity.run_clause([0, 5.0], [say, 0])[0] == 5 * toxicity.REPORTED
    assert toxicity.run_clause([0, 5.0], [aim, 0])[0] == 5 * toxicity.TARGETED
    assert toxicity.run_clause([0, 0], [menace, 0])[0] == 0
    assert toxicity.run_clause([0, 0], [menace, aim]) == (toxicity.THREAT, 0, 0, 0, 1)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    words = WORD.findall(text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(three)
    covered = {i + j for i, w in enumerate(three) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def check_rules(found, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == Counter((i, *base_rules(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in found)


def test_rules(spark, docs, rows, no_docs, labels):
    check_rules(isolation.judge(docs, isolation.train(docs, labels)).collect(), rows)
    check_rules(isolation.judge(docs, isolation.train(docs, labels.limit(0))).collect(), rows)
    assert isolation.judge(no_docs, isolation.train(no_docs, labels)).count() == 0


def test_rules_given_tables(spark):
    found = QUERIES["op4_isolation_rules"](spark, MEDIUM).collect()
    check_rules(found, [tuple(r) for r in documents(spark, MEDIUM).select("doc_id", "text").collect()])
    quality = {r.doc_id: r.quality for r in table(spark, MEDIUM, "labels").collect()}
    judged = [(quality[r.doc_id], r.kept, r.anomaly) for r in found if r.doc_id in quality and not r.base_failed]
    assert np.mean([k for q, k, _ in judged if q == 1]) > 0.97
    good, bad = [np.array([a for q, _, a in judged if q == x]) for x in (1, 0)]
    assert np.mean(bad[:, None] > good[None, :]) > 0.8


def test_forest_isolates_the_odd_row():
    x = np.vstack([np.random.default_rng(1).normal(size=(300, 3)), [[9, 9, 9]]])
    score = isolation.grow(x).scores(x)
    assert score.argmax() == 300
    assert isolation.grow(x[:1]) is None and isolation.grow(np.zeros((5, 2))).scores(np.zeros((2, 2))).shape == (2,)


def test_rules_learn_from_all_rows(spark):
    """Each row is in a tree, and the cut is the one of all labelled rows, beyond any sample of them."""
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)] + ["#", "A$", "9!"]
    texts = [" ".join(random.choice(words, 60, p=[(1 - s) / 400] * 400 + [s / 3] * 3)) for s in random.beta(1, 8, 5200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stats = dict(zip((*isolation.COUNTS, *isolation.EXTRA), isolation.statistics(pa.array(texts)), strict=True))
    x, failed = isolation.features(stats), isolation.base_failed(stats)
    quality = (x[:, 0] + random.normal(0, 0.05, len(x)) < 0.1).astype(int)
    labels = spark.createDataFrame([(i, int(q), 0, "") for i, q in enumerate(quality)], LABELS)
    forest = isolation.train(docs, labels)
    assert len(set(quality[~failed])) == 2 and (~failed).sum() > 5000
    cut = -best_cut(-forest.scores(x[~failed]), quality[~failed], isolation.LOSS)
    assert forest.cut == pytest.approx(cut, abs=1e-12)
    # the trees see the ends of every feature: a row beyond all others moves a split
    odd = docs.unionByName(spark.createDataFrame([(10**6, "!" * 300)], "doc_id long, text string"))
    assert not np.array_equal(isolation.train(odd, labels).split, forest.split)
    taught = isolation.lessons(isolation.measured(docs), labels)
    share = -(-isolation.LEAST_ROWS * isolation.TREES // len(rows))
    assert isolation.gatherer(taught)(forest, share, 0).rows.sum() == share * len(rows)


@pytest.mark.parametrize("decimals", [1, 2, 6])
def test_cut_of_all_rows(spark, decimals, monkeypatch):
    monkeypatch.setattr(isolation, "BLOCKS", 16)
    random = np.random.default_rng(decimals)
    y = random.integers(0, 2, 300)
    for shift, labels in ((0.3, y), (0.0, y), (-0.9, y), (0.3, y * 0)):
        score = np.round(np.clip(0.5 + shift * (0.5 - labels) + random.normal(0, 0.1, 300), 0, 1), decimals)
        df = spark.createDataFrame([*zip(score.tolist(), labels.tolist(), strict=True)], "anomaly double, label int")
        want = -best_cut(-score, labels, 4.0) if labels.any() else None
        assert isolation.cut_of(df, 4.0) == (want if want is None else pytest.approx(want, abs=1e-12))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base_spans(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 13 <= len(digits) <= 19 and check % 10 == 0:
            out.append(("card", m.start(), m.end()))
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return out + [("phone", m.start(), m.end()) for m in phones if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.@ab-+ ()é_%", max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == base_spans(text)


def test_base_spans_of_very_long_runs():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1.2." * 50_000, "+1 (" * 50_000, "12 34-" * 50_000):
        assert isinstance(pii.base_spans(text), list)


def test_personal_data(spark, docs, no_docs):
    trees = pii.train(documents(spark, MEDIUM))
    rows = [(i, r.text) for i, r in enumerate(documents(spark, SMALL).collect())]
    rows += [(None, "mail é.a@b.example 1.2.3.4 and 1.2.3.400"), (-1, None), (-2, ""), (-3, "x " * 20_000 + "+49 (30) 1234567")]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), trees).collect()
    texts = dict(rows)
    for r in found:
        base = base_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert r.spans.startswith(own) and (r.n_added > 0) == (len(r.spans) > len(own))
    assert sum(r.n_added for r in found) > 0
    assert pii.find_personal(no_docs, pii.train(no_docs)).count() == 0
    assert pii.redact(docs, trees).columns == docs.columns


def test_redaction():
    text = "a b@c.de and 1.2.3.4 end"
    assert pii.redacted(text, pii.base_spans(text)) == "a [EMAIL] and [IP] end"
    assert pii.redacted("0123456789", [("x", 2, 5), ("y", 4, 7)]) == "01[X]789"
