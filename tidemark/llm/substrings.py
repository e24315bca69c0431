"""Substring dedup: removal of every 50-word passage that an earlier document has.

Every window of 50 consecutive words gets a Rabin-Karp hash, from running sums.
Counting all windows would shuffle one row per word of the corpus; two exact
steps before the count avoid that:

* Each window has an *anchor*, the least hash among its 8-word grams. Equal
  windows have equal anchors, so only windows whose anchor occurs in two
  documents can repeat. Neighbouring windows share anchors, hence the rows that
  are shuffled are runs of windows, about one per 20 words.
* A run carries a hash of all the words it covers. Where every run of an anchor
  is the same (copies, the inside of common passages), the least id decides for
  all its windows at once. With the other shared anchors that holds among the
  runs that are the same; the windows of the first of those are counted one by
  one, by (anchor, window hash), together 128 bits.

A window repeats if its hash also starts in a document with a smaller id. The
repeated windows of a document are merged into maximal intervals, and the words
in them go. Counts combine before they are shuffled, and joins may be split by
AQE where an anchor is hot. The runs with shared anchors are written to the
shared folder; what follows is one query, which shuffles the texts once.

Defined results: null and empty texts have no words; a document never repeats
itself, nor another row with the same id; null ids neither lose words nor take
them from others; rows that are alike in all columns give equal rows. Texts and
extra columns of the input do not meet the column names used here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import documents
from tidemark.llm.words import (
    WORD_BASES,
    Words,
    mix,
    rolling,
    segment_hash,
    signed,
    slices,
    within_rows,
    words_of,
)
from tidemark.session import materialize

#: fixed value of the contract
WINDOW = 50
#: words of the grams among which a window's anchor is chosen
GRAM = 8

RUNS = "doc_id long, text_key int, anchor long, start int, n int, sig long"
WINDOWS = "doc_id long, text_key int, anchor long, hash long, start int"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:int,stop:int>>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    if len(hashes) < window:
        return np.zeros(0, dtype=np.uint64)
    return sliding_min(mix(rolling(hashes, gram, WORD_BASES[1])), window - gram + 1)


def find_runs(words: Words, window: int, gram: int):
    """Row, anchor, first window (in the row), windows and signature of each run of equal anchors."""
    hashes = words.hashes()
    anchor, valid, row = anchors(hashes, window, gram), within_rows(words, window), words.row()
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(begins)
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | begins[1:]
    n = np.flatnonzero(stops) + 1 - start
    sig = mix(segment_hash(hashes, start, start + n + window - 1, WORD_BASES[0]) + n.astype(np.uint64))
    row = row[start]
    return row, anchor[start], start - words.first[row], n, sig


def run_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, anchor, start, n, sig = find_runs(words_of(part.column("text")), window, gram)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(at),
                    part.column("text_key").take(at),
                    pa.array(signed(anchor)),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(signed(sig)),
                ],
                ["doc_id", "text_key", "anchor", "start", "n", "sig"],
            )

    return rows


def spread(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's windows one by one: row and window."""
    before = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), np.repeat(start, n) + np.arange(n.sum()) - before


def listed(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row of each element of a list column, and the elements."""
    return column.value_parent_indices().to_numpy(), column.flatten()


def window_rows(window: int, gram: int):
    """The windows of the runs listed for each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"))
            hashes = words.hashes()
            row, runs = listed(part.column("runs"))
            row, start = spread(row, *(runs.field(x).to_numpy() for x in ("start", "n")))
            at = words.first[row] + start
            keys = mix(segment_hash(hashes, at, at + window, WORD_BASES[0]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(take),
                    part.column("text_key").take(take),
                    pa.array(signed(anchors(hashes, window, gram)[at])),
                    pa.array(signed(keys)),
                    pa.array(start.astype(np.int32)),
                ],
                ["doc_id", "text_key", "anchor", "hash", "start"],
            )

    return rows


def merged(start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal word intervals covered by the windows of the runs."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate((start + n + window - 1)[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > stop[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return start[new], stop[last]


def cut_rows(window: int):
    """The digest of what is left of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = {"doc_id": part.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "intervals": []}
            for text, runs in zip(part.column("text"), part.column("runs"), strict=True):
                words = (text.as_py() or "").encode().split()
                kept, at, cuts = words, 0, []
                if runs.is_valid and len(runs.values):
                    starts, stops = merged(*(runs.values.field(x).to_numpy() for x in ("start", "n")), window)
                    kept, cuts = [], list(zip(starts.tolist(), stops.tolist(), strict=True))
                    for start, stop in cuts:
                        kept += words[at:start]
                        at = stop
                    kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["intervals"].append([{"start": a, "stop": b} for a, b in cuts])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return rows


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of repeated windows per text: (doc_id, text_key, runs). ``docs``: doc_id, text_key, text."""
    runs = docs.where("doc_id is not null").mapInArrow(run_rows(window, gram), RUNS)
    shared = (
        runs.groupBy("anchor")
        .agg(*[f(c).alias(f"{n}_{c}") for c in ("doc_id", "sig") for n, f in (("min", F.min), ("max", F.max))])
        .where("min_doc_id < max_doc_id")
        .select("anchor", F.col("min_doc_id").alias("first_doc"), F.expr("min_sig = max_sig").alias("alike"))
    )
    hits = materialize(runs.join(shared, "anchor"), "runs")
    listed_ = F.collect_list(F.struct("start", "n")).alias("runs")
    # of runs that are alike, only the first document's needs its windows counted
    open_ = hits.where("not alike").select("doc_id", "text_key", "anchor", "sig", "start", "n")
    same = open_.groupBy("anchor", "sig").agg(F.min("doc_id").alias("first_doc"))
    open_ = open_.join(same, ["anchor", "sig"])
    whole = (
        hits.where("alike").select("doc_id", "text_key", "start", "n", "first_doc")
        .unionByName(open_.select("doc_id", "text_key", "start", "n", "first_doc"))
        .where("doc_id > first_doc")
        .drop("first_doc")
    )
    open_ = open_.where("doc_id = first_doc").groupBy("doc_id", "text_key").agg(listed_)
    windows = (
        docs.join(open_, ["doc_id", "text_key"])
        .select("doc_id", "text_key", "text", "runs")
        .mapInArrow(window_rows(window, gram), WINDOWS)
    )
    first = (
        windows.groupBy("anchor", "hash")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc")
        .drop("last_doc")
    )
    single = (
        windows.join(first, ["anchor", "hash"])
        .where("doc_id > first_doc")
        .select("doc_id", "text_key", "start", F.lit(1).alias("n"))
    )
    return whole.unionByName(single).groupBy("doc_id", "text_key").agg(listed_)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: words, removed words, hash of what is kept, and the removed word intervals."""
    texts = docs.select("doc_id", F.hash("text").alias("text_key"), "text")
    runs = repeated_runs(texts, window, gram)
    both = texts.join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(cut_rows(window), KEPT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest after the removal of passages that an earlier one has."""
    return remove_repeats(documents(spark, sf_dir)).drop("intervals")
