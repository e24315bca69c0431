"""Every generator of personal data must be able to take effect."""

import pyarrow as pa
import pytest

from tests.conftest import MEDIUM
from tidemark.llm import pii
from tidemark.llm.tables import documents


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(documents(spark, MEDIUM))


PERSONAL = {
    "secret": 'ein password = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" steht hier',
    "local_phone": "you may call me (030) 555-1234 in the evening",
    "long_number": "sent to account 48151623 last week",
    "account": "the iban DE89370400440532013000 was used, ssn 123-45-6789 as well",
    "ipv6": "from host 2001:db8:0:1:1:1:7:ab came more",
    "spelled_email": "write to jane.doe [at] mail [dot] example about it",
}


@pytest.mark.parametrize("kind", pii.GENERATORS)
def test_planted(trees, kind):
    text = PERSONAL[kind]
    ((full, base, chosen),) = pii.spans_of(pa.array([text]), trees)
    assert full == text and base == []
    assert {k for k, _, _ in chosen} == {kind}
    assert len(chosen) == len([s for s in pii.proposals(text) if s[0] == kind])


def test_planted_without_a_sample(spark, no_docs):
    trees = pii.train(no_docs)
    for kind, text in PERSONAL.items():
        assert {k for k, _, _ in pii.select(text, [], trees)} == {kind}


def test_others_stay(trees):
    for text in (
        "see page 123 555 4081 and isbn 48151623 there",
        "the code DE88370400440532013000 is not one",
        "part 000-12-3456 and 987-65-4321",
        "device 00:1a:2b:3c:4d:5e at 10:20:30:40:50",
    ):
        assert pii.select(text, pii.base_spans(text), trees) == [], text


def test_texts_without_digit_and_at_sign_are_searched(trees):
    texts = ["mail joe(at)host(dot)org now", "plain (atlas) text: none", "host ab:cd:ef:ab:cd:ef:ab:cd here"]
    got = [[s[0] for s in chosen] for _, _, chosen in pii.spans_of(pa.array(texts), trees)]
    assert got == [["spelled_email"], [], ["ipv6"]]
