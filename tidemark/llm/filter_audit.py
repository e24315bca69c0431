"""How filters interact: what each removes, at each step of every order of them.

A document fails some set of the five filters, its mask. In a given order it is
removed at the first step whose filter is in the mask. Orders are numbered by
their Lehmer rank, that is lexicographically, so all orders that begin with the
same letters have neighbouring ranks. A mask is removed at step s by exactly the
orders that begin with s - 1 letters outside the mask and then one inside it, and
each such beginning is one interval of (5 - s)! ranks.

So the documents are counted by part and mask once. Each count is added at the
first rank of its intervals and taken off behind their last; running sums over the
120 ranks then give what every step of every order removes. The intervals of all
masks are a fixed table, made from the rule below.

What is shuffled per document is one row of its id, mask and text digest, in order
to find earlier copies; a family of copies is reduced to its least id before it is
met again, and met by digest and id together, so no key is hot.

Defined results: null texts are empty ones; a null lang is the part with the empty
name. Rows without id have no label, are copies of nothing and make nothing a
copy. Rows that repeat an id count each; with several labels for an id, the
greatest counts. An empty table has no parts and so no rows. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import documents, table
from tidemark.session import materialize

#: the filters' letters; a filter's bit in a mask is its place here
LETTERS = "ABCDE"
ORDERS = factorial(len(LETTERS))
#: filter A: fewer words; B: distinct words in percent; C: capitals in percent; D: any of these marks
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
BLANK = r"[\x20\x09-\x0D]+"

COUNTED = ("docs", "good", "toxic")


def lehmer_rank(start: str) -> int:
    """Rank of the first order, lexicographically, that begins with these letters."""
    left, rank = list(LETTERS), 0
    for letter in start:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def removal_intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of the orders in which the step removes the mask."""
    found = []
    for mask in range(1, 1 << len(LETTERS)):
        inside = [x for i, x in enumerate(LETTERS) if mask >> i & 1]
        outside = [x for x in LETTERS if x not in inside]
        for step in range(1, len(outside) + 2):
            width = factorial(len(LETTERS) - step)
            for before in permutations(outside, step - 1):
                firsts = [lehmer_rank("".join((*before, letter))) for letter in inside]
                found += [(mask, step, first, first + width) for first in firsts]
    return found


def text_failures(text: str = "text") -> Column:
    """The bits of the filters that look at the text alone."""
    body = F.coalesce(F.col(text), F.lit(""))
    # of an empty piece before the first or behind the last word there is no word
    words = F.filter(F.split(body, BLANK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    failed = [
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * F.length(body),
        body.rlike(MARKS),
    ]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)])


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and docs (how many rows) for ``docs`` (doc_id, text, lang), rows alike together."""
    seen = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        text_failures().alias("own"),
        # the whole digest: texts are told apart by it alone
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("same"),
    )
    seen = materialize(seen.groupBy("same", "doc_id", "part", "own").agg(F.count("*").alias("docs")), "masks")
    least = seen.groupBy("same").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("own") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)
    return seen.join(least, ["same", "doc_id"], "left").select("doc_id", "part", mask.alias("mask"), "docs")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the documents with it: all, those of good quality, the toxic ones."""
    seen = materialize(masks(docs), "masks")
    marked = (
        labels.where("quality = 1 or toxic = 1")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
        .select("doc_id", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("t", F.lit(0)).alias("t"))
    )
    nothing = F.lit(0).cast("long")
    all_rows = seen.select("part", "mask", "docs", nothing.alias("good"), nothing.alias("toxic"))
    lost = seen.where("mask != 0").join(marked, "doc_id")
    lost = lost.select("part", "mask", nothing.alias("docs"), (F.col("docs") * F.col("q")).alias("good"), (F.col("docs") * F.col("t")).alias("toxic"))
    both = all_rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])
    both = both.unionByName(lost.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED]))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the contract's columns in the query below."""
    spark = docs.sparkSession
    counts = materialize(mask_counts(docs, labels), "mask-counts")
    table_ = spark.createDataFrame(removal_intervals(), "mask int, step int, low int, high int")
    # a table of fixed size: the intervals of 31 masks
    met = counts.join(F.broadcast(table_), "mask")
    ends = met.select("part", "step", F.col("low").alias("rank"), *COUNTED).unionByName(
        met.select("part", "step", F.col("high").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTED])
    )
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("docs")).otherwise(0)).alias(f"fails_{x}") for i, x in enumerate(LETTERS)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("docs")).otherwise(0)).alias(f"alone_{x}") for i, x in enumerate(LETTERS)]
    parts = counts.groupBy("part").agg(F.sum("docs").alias("all"), *failing, *alone)
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")
    ranks = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank")
    grid = parts.select("part", steps).select("part", "step", ranks)
    zeros = grid.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTED])
    changes = ends.where(F.col("rank") < ORDERS).unionByName(zeros)
    changes = changes.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTED])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in COUNTED])
    names = spark.createDataFrame(
        [(rank, "".join(order)) for rank, order in enumerate(permutations(LETTERS))], "rank int, filter_order string"
    )
    steps_so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))

    def of_letter(kind: str) -> Column:
        return reduce(lambda c, x: c.when(F.col("letter") == x, F.col(f"{kind}_{x}")), LETTERS[1:], F.when(F.col("letter") == "A", F.col(f"{kind}_A")))

    return (
        removed.join(F.broadcast(names), "rank")
        .withColumn("letter", letter)
        .withColumn("gone", F.sum("docs").over(steps_so_far))
        # a part and letter have 120 rows here
        .withColumn("shapley", F.sum("docs").over(Window.partitionBy("part", "letter")))
        .join(parts, "part")
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("all") - F.col("gone")).alias("kept"),
            F.col("docs").alias("removed"),
            (of_letter("fails") - F.col("docs")).alias("redundant"),
            of_letter("alone").alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            "shapley",
        )
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each language, at each step of all 120 orders."""
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
