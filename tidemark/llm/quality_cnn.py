"""Document quality by a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded and ``FILTERS`` learned filters of ``WIDTH``
bytes slide over all of it in steps of ``STRIDE``. Their outputs are max-pooled in
chunks that overlap by half. The largest and the mean pooled value of each filter
over all chunks enter one logistic unit. Embedding and filter together are a table
of 256 rows for each place in the filter, so a pass is a sum of look-ups.

It is fitted on the driver, on at most ``PER_CLASS`` labelled rows per label with
``CHARS`` characters each, by Adam with hand-written gradients; a fifth of the
rows only serves to choose the cut, which is placed at 0.7 of the score. The
fitted tables (a few hundred kB) go to every task.

Defined results: null text is empty and scored as such; every row is scored, with
null ids counted as in training; without labelled rows of both kinds every text
scores 0.7 and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import best_cut, held_out, labelled_sample
from tidemark.llm.tables import documents, table
from tidemark.llm.words import slices, text_bytes

#: fixed values of the contract: training fold and the score from which on label 1 is told
MODULO, REST, TELL = 4, 2, 0.7
FILTERS, WIDTH, STRIDE, EMBED = 16, 8, 2, 8
#: filter places pooled together in half a chunk
HALF = 128
PER_CLASS, CHARS = (1200, 1200), 4096
EPOCHS, BATCH, RATE, SEED = 14, 48, 0.004, 11
#: small samples are gone through more often
LEAST_STEPS = 600

SCORES = "doc_id long, score double"


@dataclass
class Places:
    """Where filters are applied: byte places, and the bounds of half chunks and of rows in them."""

    data: np.ndarray
    at: np.ndarray
    halves: np.ndarray  # first place of each half chunk
    rows: np.ndarray  # first half chunk of each row


def places(column: pa.Array) -> Places:
    raw, bounds = text_bytes(column)
    size = np.diff(bounds)
    # every text is followed by WIDTH zero bytes, so the shortest has a place too
    row = np.repeat(np.arange(len(size)), size)
    data = np.zeros(len(raw) + WIDTH * len(size), dtype=np.uint8)
    data[np.arange(len(raw)) + WIDTH * row] = raw
    start = bounds[:-1] + WIDTH * np.arange(len(size))
    count = size // STRIDE + 1
    first = np.cumsum(count) - count
    at = np.repeat(start - STRIDE * first, count) + STRIDE * np.arange(count.sum())
    per_row = -(-count // HALF)
    rows = np.cumsum(per_row) - per_row
    halves = np.repeat(first - HALF * rows, per_row) + HALF * np.arange(per_row.sum())
    return Places(data, at, halves, rows)


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS weights and a bias
    cut: float = 0.0
    slope: float = 1.0

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)

    def responses(self, where: Places, tables: np.ndarray) -> np.ndarray:
        total = tables[0][where.data[where.at]]
        for j in range(1, WIDTH):
            total += tables[j][where.data[where.at + j]]
        total += self.bias.astype(np.float32)
        return np.maximum(total, 0, out=total)

    @staticmethod
    def pooled(where: Places, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the maxima of half chunks: chunk maxima, each row's largest and mean."""
        n = len(top)
        last = np.zeros(n, dtype=bool)
        last[np.append(where.rows[1:], n) - 1] = True
        chunk = top.copy()
        inner = np.flatnonzero(~last)
        chunk[inner] = np.maximum(top[inner], top[inner + 1])
        size = np.diff(np.append(where.rows, n))[:, None]
        return chunk, np.maximum.reduceat(top, where.rows, axis=0), np.add.reduceat(chunk, where.rows, axis=0) / size

    def logits(self, column: pa.Array, tables: np.ndarray) -> np.ndarray:
        where = places(column)
        top = np.maximum.reduceat(self.responses(where, tables), where.halves, axis=0)
        _, most, mean = self.pooled(where, top)
        return most @ self.out[:FILTERS] + mean @ self.out[FILTERS:-1] + self.out[-1]

    def scores(self, column: pa.Array, tables: np.ndarray) -> np.ndarray:
        z = self.slope * (self.logits(column, tables).astype(np.float64) - self.cut) + np.log(TELL / (1 - TELL))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradients(self, column: pa.Array, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, by embed, filters, bias and out."""
        where, tables = places(column), self.tables()
        response = self.responses(where, tables)
        top = np.maximum.reduceat(response, where.halves, axis=0)
        chunk, most, mean = self.pooled(where, top)
        x = np.hstack([most, mean, np.ones((len(y), 1))])
        p = 1 / (1 + np.exp(-np.clip(x @ self.out, -30, 30)))
        error = (p - y) / len(y)
        d_out = x.T @ error
        n = len(top)
        per_row = np.diff(np.append(where.rows, n))
        row = np.repeat(np.arange(len(y)), per_row)
        # the gradient reaches the half chunks that hold a maximum
        d_chunk = error[row, None] * self.out[FILTERS:-1] / per_row[row, None]
        d_top = np.where(top == chunk, d_chunk, 0)
        inner = np.flatnonzero(np.append(row[1:] == row[:-1], False))
        d_top[inner + 1] += np.where(top[inner] == chunk[inner], 0, d_chunk[inner])
        largest = top == most[row]
        d_top += largest * error[row, None] * self.out[:FILTERS] / np.add.reduceat(largest, where.rows, axis=0, dtype=float)[row]
        d_top[top <= 0] = 0
        # and there the place of the maximum
        of_half = np.repeat(np.arange(n), np.diff(np.append(where.halves, len(where.at))))
        spot = np.where(response == top[of_half], np.arange(len(of_half))[:, None], -1)
        spot = np.maximum.reduceat(spot, where.halves, axis=0)
        d_tables = np.zeros((WIDTH, 256, FILTERS))
        column_of = np.broadcast_to(np.arange(FILTERS), spot.shape)
        for j in range(WIDTH):
            cell = where.data[where.at[spot] + j].astype(np.int64) * FILTERS + column_of
            d_tables[j] = np.bincount(cell.ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        d_embed = np.einsum("wbf,wef->be", d_tables, self.filters)
        return [d_embed, np.einsum("be,wbf->wef", self.embed, d_tables), d_top.sum(axis=0), d_out]


def fit(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> Network | None:
    """A fitted network; None without rows of both labels."""
    if len(set(y.tolist())) < 2:
        return None
    random = np.random.default_rng(SEED)
    net = Network(
        random.normal(0, 0.5, (256, EMBED)),
        random.normal(0, 0.25, (WIDTH, EMBED, FILTERS)),
        np.zeros(FILTERS),
        random.normal(0, 0.1, 2 * FILTERS + 1),
    )
    order = random.permutation(len(y))
    kept = max(1, len(y) // 5)
    check, train = order[:kept], order[kept:]
    if len(set(y[train].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        check = train = order
    names = ("embed", "filters", "bias", "out")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    epochs = max(epochs, -(-least_steps * BATCH // len(train)))
    for epoch in range(epochs):
        rate = RATE * min(1.0, 2 * (1 - epoch / epochs))
        shuffled = random.permutation(train)
        for low in range(0, len(shuffled), BATCH):
            some = shuffled[low : low + BATCH]
            step += 1
            for name, grad in zip(names, net.gradients(texts.take(pa.array(some)), y[some]), strict=True):
                grad = grad + 1e-4 * getattr(net, name)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                fixed = first[name] / (1 - 0.9**step), second[name] / (1 - 0.999**step)
                setattr(net, name, getattr(net, name) - rate * fixed[0] / (np.sqrt(fixed[1]) + 1e-8))
    tables = net.tables()
    z = np.concatenate([net.logits(texts.take(pa.array(check[i : i + 64])), tables) for i in range(0, len(check), 64)])
    # losing a good document costs more than keeping a bad one
    net.cut = best_cut(z, y[check], cost_of_missing_one=3.0)
    return net


def score_rows(net: Network | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for part in slices(batches):
            score = net.scores(part.column("text"), tables) if net else np.full(part.num_rows, TELL)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return rows


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    sample = labelled_sample(docs, labels, "quality", ~held_out(MODULO, REST), PER_CLASS, CHARS)
    return fit(*sample, EPOCHS, LEAST_STEPS)


def quality_scores(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    scored = docs.select("doc_id", "text").mapInArrow(score_rows(net), SCORES)
    return scored.select(
        "doc_id",
        held_out(MODULO, REST).alias("held_out"),
        "score",
        (F.col("score") >= TELL).cast("int").alias("predicted"),
    )


def keep_rows(net: Network | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for part in slices(batches):
            yield part.filter(pa.array(net.scores(part.column("text"), tables) >= TELL)) if net else part

    return rows


def keep_good(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` that are told good, with all their columns."""
    return docs.mapInArrow(keep_rows(net), docs.schema)


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the fitted network."""
    docs = documents(spark, sf_dir)
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
