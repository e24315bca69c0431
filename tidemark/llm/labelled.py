"""Bounded samples of labelled rows, and a logistic fit, for the learned operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import crc_of_id
from tidemark.session import materialize

#: slices taken evenly from a text that is longer than the training bound
SLICES = 8


def held_out(modulo: int, rest: int) -> Column:
    """Whether a document's labels are kept away from training."""
    return crc_of_id() % modulo == rest


def evenly(text: str, most: int) -> Column:
    """The whole text, or ``SLICES`` even slices of it that have ``most`` characters together."""
    size = most // SLICES
    step = (F.length(text) - size) / (SLICES - 1)
    cut = [F.substr(F.col(text), (step * i).cast("int") + 1, F.lit(size)) for i in range(SLICES)]
    return F.when(F.length(text) <= most, F.col(text)).otherwise(F.concat(*cut))


def chosen_ids(labels: DataFrame, label: str, train: Column, per_class: tuple[int, int]) -> DataFrame:
    """doc_id and _y (0 or 1) of at most ``per_class`` ids of each label, those with the least hash."""
    known = labels.where(train & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    order = F.xxhash64("doc_id")
    chosen = None
    for y, most in enumerate(per_class):
        some = known.where(F.col("_y") == y).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    return chosen


def whole_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, y and the whole text of the rows that ``labelled_sample`` takes.

    Rows alike in id and text count once. The texts stay in Spark; what is learned
    from them is computed in tasks.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    keys = (
        own.join(F.broadcast(chosen_ids(labels, label, train, per_class)), "doc_id")
        .select("doc_id", "text_key", F.col("_y").alias("y"))
        .dropDuplicates()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text_key")
        .limit(sum(per_class))
    )
    # at most sum(per_class) rows of three numbers
    same = ["doc_id", "text_key"]
    return materialize(own.join(F.broadcast(keys), same).dropDuplicates([*same, "y"]), "labelled")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: tuple[int, int], chars: int
) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most ``per_class`` rows of each label.

    The rows with the least hash of their id are taken, each id once; at most
    ``chars`` characters of a text. Only such a sample reaches the driver.
    """
    chosen = chosen_ids(labels, label, train, per_class)
    # at most sum(per_class) rows of two numbers
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "_y", evenly("text", chars).alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(sum(per_class))
        .toArrow()
        .combine_chunks()
    )
    text = rows.column("text")
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    return text, rows.column("_y").to_numpy().astype(np.int64)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and bias (last) by Newton steps; ``x`` should be scaled."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(score: np.ndarray, y: np.ndarray, cost_of_missing_one: float = 1.0) -> float:
    """The score above which label 1 is told, with the fewest (weighted) errors; in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    s, own = score[order], y[order]
    # cut before place i: those from i on are told 1
    missed = np.concatenate([[0], np.cumsum(own == 1)]) * cost_of_missing_one
    wrong = np.concatenate([np.cumsum((own == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    valid = np.concatenate([[True], s[1:] > s[:-1], [True]])
    cost = np.where(valid, missed + wrong, np.inf)
    # of equal cuts, the one in the widest gap
    gap = np.concatenate([[0.0], s[1:] - s[:-1], [0.0]])
    best = np.flatnonzero(cost == cost.min())
    return float(edges[best[np.argmax(gap[best])]])
