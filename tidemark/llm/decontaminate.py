"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items are cut into tokens: runs of letters, digits and
non-ASCII bytes, A-Z lower-cased. A seed is a mask over neighbouring tokens that
looks at some places and ignores the others, so one changed token spoils only the
seeds that look at it. Both masks together hit every stretch of 13 tokens in which
up to two are substituted. Seeds of the documents are joined with those of the
items on their hash; each hit fixes how text and item lie against each other, and
that alignment is verified token by token: a document leaks an item if some 13
aligned tokens hold at least 11 equal ones.

Items of 8 to 12 tokens must be there as a whole with at most one substitution;
their seeds are four neighbours, one of which always stays whole. Items of 1 to 7
tokens must be there whole and unchanged: the seed is the item itself, one hash for
each length. An item of one common word is thus in every text that holds the word.

The seeds of the benchmark go to the tasks in one sorted array while they number
up to ``BROADCAST_SEEDS``; beyond that the same hits come from a shuffled join,
which verifies each different text against each different item once.

Defined results: null and empty texts and items match nothing; rows with a null
id are reported with it; documents that repeat are reported each; items that repeat
are one, and an item_id with several texts is one item that any of them shows;
further columns are ignored. One row is given per document and item_id, for the best
alignment (most equal tokens, then the first place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shingles import list_array
from tidemark.llm.tables import documents, table
from tidemark.llm.words import NOT_ALNUM, Words, mix, powers, signed, slices, words_of
from tidemark.session import materialize

#: aligned tokens that are looked at, and how many of them may differ
STRETCH, DIFFER = 13, 2
#: items of fewer tokens are matched whole
LEAST_ITEM = 8
#: places that the masks look at
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 6, 7))
SHORT_MASK = (0, 1, 2, 3)
#: masks of whole items have this number and their length
WHOLE = 100
#: hashes sent to every task (8 MB and as much for their places); a larger benchmark is joined by shuffle
BROADCAST_SEEDS = 1_000_000

BASE = 0xC2B2AE3D27D4EB4F
LEAKS = "doc_id long, item_id long, start int, stop int, matched int, length int"
SEEDS = "doc_id long, text_key long, hash long, place int"
ITEMS = "item_id long, tokens array<long>"


def tokens_of(column: pa.Array) -> Words:
    return words_of(column, lower=True, blank=NOT_ALNUM)


def mask_of(number: int) -> tuple[int, ...]:
    """-1 is the short mask; numbers from WHOLE on are whole items of so many tokens more."""
    if number >= WHOLE:
        return tuple(range(number - WHOLE))
    return SHORT_MASK if number < 0 else MASKS[number]


def seeds(hashes: np.ndarray, first: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of the seeds of one mask."""
    mask = mask_of(number)
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = powers(BASE, span + 1)
    total = np.full(n, number + 2, dtype=np.uint64)
    for place in mask:
        total += hashes[place : place + n] * factor[place + 1]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(row[:n] == row[span - 1 :])
    return mix(total[inside]), inside


def stretch_of(n: int) -> tuple[int, int]:
    """Aligned tokens to look at and equal ones to find, for an item of n tokens."""
    width = min(n, STRETCH)
    return width, width - (DIFFER * width // STRETCH if n >= LEAST_ITEM else 0)


def masks_of(n: int) -> list[int]:
    """The masks of an item of n tokens."""
    if n >= STRETCH:
        return [*range(len(MASKS))]
    return [-1] if n >= LEAST_ITEM else [WHOLE + n] if n else []


def verify(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Bounds in the text and equal tokens of what an alignment shares; None if too little."""
    width, least = stretch_of(len(item))
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if high - low < width:
        return None
    equal = np.concatenate([[0], np.cumsum(text[low + diagonal : high + diagonal] == item[low:high])])
    good = np.flatnonzero(equal[width:] - equal[:-width] >= least)
    if not len(good):
        return None
    start, stop = int(good[0]), int(good[-1]) + width
    return low + diagonal + start, low + diagonal + stop, int(equal[stop] - equal[start])


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = tokens_of(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [part.column("item_id"), list_array(signed(words.hashes()), words.first)], ["item_id", "tokens"]
        )


def item_seeds(ids: np.ndarray, tokens: list[np.ndarray]) -> list[np.ndarray]:
    """Seed hashes of items with the item's number and the place in it."""
    hashes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, own in enumerate(tokens):
        for number in masks_of(len(own)):
            value, at = seeds(own.view(np.uint64), np.array([0, len(own)]), number)
            hashes.append(value)
            item.append(np.full(len(at), i))
            place.append(at)
    return [np.concatenate(x) for x in (hashes, item, place)]


def seed_numbers(lengths) -> list[int]:
    """The masks that items of these lengths use."""
    return sorted({number for n in lengths for number in masks_of(int(n))})


def report(rows: list, doc_ids: pa.Array) -> pa.RecordBatch:
    """Best alignment per row and item; rows: (row, item id, start, stop, matched, length)."""
    best: dict = {}
    for row, item, start, stop, matched, length in rows:
        now = (-matched, start, stop, length)
        if (row, item) not in best or now < best[row, item]:
            best[row, item] = now
    keys = sorted(best, key=lambda k: (k[0], k[1] is not None, k[1] or 0))
    got = [best[k] for k in keys]
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array([k[0] for k in keys], pa.int64())),
            pa.array([k[1] for k in keys], pa.int64()),
            *[pa.array(x, pa.int32()) for x in ([g[1] for g in got], [g[2] for g in got], [-g[0] for g in got], [g[3] for g in got])],
        ],
        ["doc_id", "item_id", "start", "stop", "matched", "length"],
    )


def leak_rows(item_ids: list, tokens: list[np.ndarray]):
    """Leaks found with the whole benchmark at hand."""
    value, item, place = item_seeds(np.arange(len(tokens)), tokens)
    order = np.argsort(value, kind="stable")
    value, item, place = value[order], item[order], place[order]
    known = np.zeros(1 << 20, dtype=bool)  # answers most look-ups from the processor's cache
    known[(value >> np.uint64(44)).astype(np.int64)] = True
    numbers = seed_numbers({len(t) for t in tokens})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = tokens_of(part.column("text"))
            hashes, of_row = words.hashes(), words.row()
            met: set = set()
            whole: set = set()
            found = []
            for number in numbers:
                own, at = seeds(hashes, words.first, number)
                may = np.flatnonzero(known[(own >> np.uint64(44)).astype(np.int64)])
                low = np.searchsorted(value, own[may], side="left")
                high = np.searchsorted(value, own[may], side="right")
                hit = high > low
                for token, a, b in zip(at[may[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                    row = int(of_row[token])
                    inside = token - int(words.first[row])
                    if number < WHOLE:
                        met.update((row, i, inside - p) for i, p in zip(item[a:b].tolist(), place[a:b].tolist(), strict=True))
                        continue
                    # the first place of a whole item is its best one
                    text = signed(hashes[words.first[row] : words.first[row + 1]])
                    for i in item[a:b].tolist():
                        if (row, i) not in whole and (span := verify(text, tokens[i], inside)) is not None:
                            whole.add((row, i))
                            found.append((row, item_ids[i], *span, len(tokens[i])))
            for row, i, diagonal in met:
                text = signed(hashes[words.first[row] : words.first[row + 1]])
                if (span := verify(text, tokens[i], diagonal)) is not None:
                    found.append((row, item_ids[i], *span, len(tokens[i])))
            yield report(found, part.column("doc_id"))

    return rows


def seed_rows(numbers: list[int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = tokens_of(part.column("text"))
            hashes, of_row = words.hashes(), words.row()
            got = [seeds(hashes, words.first, number) for number in numbers]
            value, at = [np.concatenate(x) for x in zip(*got, strict=True)]
            row = of_row[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(take),
                    part.column("text_key").take(take),
                    pa.array(signed(value)),
                    pa.array((at - words.first[row]).astype(np.int32)),
                ],
                ["doc_id", "text_key", "hash", "place"],
            )

    return rows


def item_seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        tokens = [np.asarray(x.values.to_numpy() if len(x) else [], dtype=np.int64) for x in part.column("tokens")]
        value, item, place = item_seeds(np.arange(len(tokens)), tokens)
        yield pa.RecordBatch.from_arrays(
            [part.column("item").take(pa.array(item)), pa.array(signed(value)), pa.array(place.astype(np.int32))],
            ["item", "hash", "item_place"],
        )


def check_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best alignment of each row's text and item, of the diagonals that came from a join."""
    for part in slices(batches):
        words = tokens_of(part.column("text"))
        hashes, rows, found = words.hashes(), [], []
        for row in range(part.num_rows):
            text = signed(hashes[words.first[row] : words.first[row + 1]])
            item = part.column("tokens")[row].values.to_numpy()
            spans = (verify(text, item, diagonal) for diagonal in part.column("diagonals")[row].as_py())
            best = min(((-m, a, b) for a, b, m in filter(None, spans)), default=None)
            if best is not None:
                rows.append(row)
                found.append((*best, len(item)))
        columns = list(zip(*found, strict=True)) or [()] * 4
        named = [part.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text_key", "item")]
        yield pa.RecordBatch.from_arrays([*named, *[pa.array(c, pa.int32()) for c in columns]], [c.split()[0] for c in CHECKED.split(", ")])


CHECKED = "doc_id long, text_key long, item long, missed int, start int, stop int, length int"


def joined_leaks(docs: DataFrame, items: DataFrame, numbers: list[int]) -> DataFrame:
    """The same leaks for a benchmark of any size, by a join of the hashes.

    Texts and items that repeat are looked at once; the copies' rows are made from
    their number at the end.
    """
    items = items.where(F.size("tokens") > 0).withColumn("item", F.xxhash64("tokens"))
    names = items.select("item", "item_id").distinct()
    shapes = items.groupBy("item").agg(F.first("tokens").alias("tokens"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    copies = texts.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    texts = texts.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    own = texts.mapInArrow(seed_rows(numbers), SEEDS)
    theirs = shapes.mapInArrow(item_seed_rows, "item long, hash long, item_place int").distinct()
    met = (
        own.join(theirs, "hash")
        .groupBy("doc_id", "text_key", "item")
        .agg(F.collect_set(F.col("place") - F.col("item_place")).alias("diagonals"))
    )

    def same(a: DataFrame, b: DataFrame):
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])

    best = (
        met.join(texts, same(met, texts))
        .select(met["doc_id"], met["text_key"], "text", "item", "diagonals")
        .join(shapes, "item")
        .select("doc_id", "text_key", "text", "item", "tokens", "diagonals")
        .mapInArrow(check_rows, CHECKED)
        .join(names, "item")
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.min(F.struct("missed", "start", "stop", "length")).alias("best"))
    )
    return (
        best.join(copies, same(best, copies))
        .select(best["doc_id"], "item_id", "best", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "item_id", "best.start", "best.stop", (-F.col("best.missed")).alias("matched"), "best.length")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Leaks of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text)."""
    items = materialize(benchmark.select("item_id", "text").mapInArrow(item_rows, ITEMS).distinct(), "items")
    # lengths beyond the longest mask use the same masks
    length = F.least(F.size("tokens"), F.lit(STRETCH))
    lengths = [r.n for r in items.select(length.alias("n")).distinct().collect()]
    total = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    numbers = seed_numbers(lengths)
    docs = docs.select("doc_id", "text")
    if not numbers:
        return docs.limit(0).mapInArrow(leak_rows([], []), LEAKS)
    if total * len(MASKS) > most_seeds:
        return joined_leaks(docs, items, numbers)
    held = items.toArrow().combine_chunks()
    tokens = [np.asarray(x.values.to_numpy() if x.is_valid and len(x) else [], dtype=np.int64) for x in held.column("tokens")]
    return docs.mapInArrow(leak_rows(held.column("item_id").to_pylist(), tokens), LEAKS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
