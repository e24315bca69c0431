"""Small documents with every awkward case, and their extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, shard string, slot string, part string, start string, n string, id string, value string, text_key string"
)


def sentence(random_: random.Random, n: int) -> str:
    return " ".join(random_.choice("abcdefghij") + str(random_.randrange(400)) for _ in range(n))


def awkward_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, a very long one, copies, near copies, shared passages, repeated ids and rows."""
    r = random.Random(4)
    passage, base = sentence(r, 70), sentence(r, 120).split()
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "one two three")]
    rows += [(None, sentence(r, 60)), (None, passage), (None, None)]
    rows += [(10 + i, f"{sentence(r, 15)}\n{passage} {sentence(r, i)}") for i in range(12)]
    rows += [(40 + i, " ".join(base)) for i in range(6)]
    for i in range(30):
        near = list(base)
        for _ in range(i % 9):
            near[r.randrange(len(near))] = f"x{r.randrange(10**6)}"
        rows.append((60 + i, " ".join(near)))
    rows += [(100, sentence(r, 30_000)), (101, "a" * 50_000), (102, "spam " * 400)]
    rows += [(110, "first text of this id " * 20), (110, "second text of this id " * 20), (111, passage), (111, passage)]
    rows += [(200 + i, sentence(r, r.randrange(1, 200))) for i in range(60)]
    r.shuffle(rows)
    return rows


def as_documents(spark, rows):
    """A documents table with columns whose names the operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), *[f"own{k}" for k in range(9)]) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return as_documents(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_documents(spark, []).limit(0)
