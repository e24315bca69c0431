"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's shingles are hashed once; the k least hashes are its sketch.

* Documents with equal sets form a class from the start, by a 128-bit hash of
  the set; only the class's least document goes on.
* The retained hashes are posted in inverted lists. From each list of up to
  ``LIST`` documents come all its pairs; how often and at which ranks a pair
  meets gives the sketch of the union, and with it the estimate that filters.
* Lists beyond that are hot: common lines, passages, or large families of near
  copies. Most of their documents meet nowhere else and are far apart; only those
  whose sketch has enough hot hashes to be linked through nothing but hot lists
  are looked at further. They are compared inside numpy in blocks of bounded
  size, on their full sets, and each block returns its links in star form, so
  no list of pairs is made, however large the family. Each block first meets the
  list's hub, by which a family becomes one component; then only documents outside
  the list's largest component meet the other blocks. What is shuffled thus grows
  with a family, not with its square.
* Pairs from short lists are confirmed on the full sets. Links become components
  by star contraction.

Linked is who has 100 * |A and B| >= similarity * |A or B|. How many of the k = 24
retained hashes linked documents share at least, and how many hot hashes are looked
at, follow from the similarity such that a link is lost with a chance of ``LOSS``
at most; similarities too low for that are refused.

Defined results: no words (or null text) means an empty set, linked with nothing.
Rows with the same id are one document, linked through any of its texts; rows
without id are linked with nothing and have a null component; an empty table gives
no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shingles import list_array, shingle_sets
from tidemark.llm.tables import documents, write_clean
from tidemark.llm.words import WORD_BASES, mix, segment_hash, signed, slices
from tidemark.session import materialize

#: retained hashes of a sketch
SKETCH = 24
#: the chance that a link of just the similarity is lost
LOSS = 1.1e-7
#: documents in an inverted list whose pairs are made one by one
LIST = 60
#: rows and shingles of a block, and documents of a list's hub
BLOCK_ROWS, BLOCK_SHINGLES, HUB = 1000, 400_000, 100

SKETCHED = "doc_id long, n_shingles long, key1 long, key2 long, sketch array<long>"
#: a class of equal sets is told by its least id and a hash of the set, as an id may have several texts
CLASS = ["id", "key"]
SETS = "id long, key long, shingles array<long>"
LINKS = "u long, v long"


def set_keys(value: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    size = np.diff(bounds).astype(np.uint64)
    return [signed(mix(segment_hash(value.view(np.uint64), bounds[:-1], bounds[1:], b) + size)) for b in WORD_BASES]


def sketch_rows(width: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, bounds = shingle_sets(part.column("text"), width)
            size = np.diff(bounds)
            keys = set_keys(value, bounds)
            held = np.minimum(size, k)
            rank = np.arange(len(value)) - np.repeat(bounds[:-1], size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(size.astype(np.int64)),
                    *[pa.array(key) for key in keys],
                    list_array(value[rank < k], np.concatenate([[0], np.cumsum(held)])),
                ],
                ["doc_id", "n_shingles", "key1", "key2", "sketch"],
            )

    return rows


def set_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, bounds = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(set_keys(value, bounds)[0]), list_array(value, bounds)], ["id", "key", "shingles"]
            )

    return rows


def least_shared(similarity: int) -> int:
    """Retained hashes that linked documents share but for a chance of LOSS."""
    s, chance = similarity / 100, 0.0
    for m in range(SKETCH + 1):
        chance += comb(SKETCH, m) * s**m * (1 - s) ** (SKETCH - m)
        if chance > LOSS:
            break
    if not m:
        raise ValueError(f"sketches of {SKETCH} hashes find no links of similarity {similarity}")
    return m


def hot_keys(similarity: int) -> int:
    """Hot hashes by which documents are compared, so that linked ones share one but for a chance of LOSS."""
    return 1 if similarity >= 100 else ceil(log(LOSS) / log(1 - similarity / 100))


def needed(n: Column, similarity: int) -> Column:
    """Retained hashes that a document with ``n`` shingles shares with any linked one."""
    return F.least(F.lit(least_shared(similarity)), F.ceil(n * similarity / 100))


def block_links(similarity: int):
    """Links among the rows of one block, as (row, least row that it reaches in the block)."""

    def links(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids = block.column("id").to_numpy()
        sets = block.column("shingles").chunk(0) if block.num_rows else None
        if len(ids) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        row = place[sets.value_parent_indices().to_numpy()]
        _, column, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        size = np.bincount(row, minlength=len(ids)).astype(np.float32)
        shared = np.flatnonzero(count > 1)
        both = np.zeros((len(ids), len(ids)), dtype=np.float32)
        compact = np.full(len(count), -1)
        compact[shared] = np.arange(len(shared))
        column = compact[column]
        for low in range(0, len(shared), 2048):
            here = (column >= low) & (column < low + 2048)
            part = np.zeros((len(ids), 2048), dtype=np.float32)
            part[row[here], column[here] - low] = 1
            both += part @ part.T
        # row by row in strips, so that the square of the block is there once as numbers and once as flags
        strips = [slice(low, low + 256) for low in range(0, len(ids), 256)]
        near = np.eye(len(ids), dtype=bool)
        for strip in strips:
            near[strip] |= 100 * both[strip] >= similarity * (size[strip, None] + size[None, :] - both[strip])
        del both
        label = np.arange(len(ids), dtype=np.int32)
        while True:
            least = np.concatenate([np.where(near[strip], label[None, :], label.size).min(axis=1) for strip in strips]).astype(np.int32)
            least = least[least]
            if (least == label).all():
                break
            label = least
        linked = label != np.arange(len(ids))
        return pa.table({"u": ids[linked], "v": ids[label[linked]]})

    return links


def hot_rows(hot: DataFrame, similarity: int) -> DataFrame:
    """(value, id, key, n) of documents that may be linked through hot lists only, and of each list in how many blocks it is cut."""
    first = F.row_number().over(Window.partitionBy(*CLASS).orderBy("rank"))
    keyed = hot.where(F.col("hot") >= needed(F.col("n"), similarity)).withColumn("_k", first)
    keyed = keyed.where(F.col("_k") <= hot_keys(similarity)).select("value", *CLASS, "n")
    size = keyed.groupBy("value").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    return keyed.join(size.select("value", "rows", blocks_of("rows", "shingles").alias("blocks")), "value")


def blocks_of(rows: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def dealt(blocks: str, salt: int) -> Column:
    """A block for each class."""
    return F.pmod(F.xxhash64(F.lit(salt), *CLASS), F.col(blocks)).cast("int")


def first_meetings(rows: DataFrame) -> DataFrame:
    """(value, one, two, id, key): each block of a list meets itself and the list's hub.

    The hub is some HUB documents of the list. A family of near copies becomes one
    component by it, whatever block its members are in.
    """
    own = rows.select("value", dealt("blocks", 1).alias("one"), F.lit(-1).alias("two"), *CLASS)
    hub = rows.where("blocks > 1").where(F.pmod(F.xxhash64(F.lit(2), *CLASS), F.ceil(F.col("rows") / HUB)) == 0)
    hub = hub.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a hub document is in its own block already
    hub = hub.where(F.col("one") != dealt("blocks", 1))
    return own.unionByName(hub.select("value", "one", F.lit(-1).alias("two"), *CLASS))


def further_meetings(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Meetings of documents that are not yet in the largest component of their list with all of the list.

    Within a component nothing is left to be found. Documents outside the largest
    one meet each other, block by block, and the blocks of the largest one.
    """
    wide = rows.where("blocks > 1").join(components.withColumnRenamed("node", "id"), "id", "left")
    wide = wide.withColumn("component", F.coalesce("component", "id"))
    sizes = wide.groupBy("value", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    top = sizes.groupBy("value").agg(
        F.max_by("component", F.struct("size", "component")).alias("top"),
        F.max("size").alias("inside"),
        F.max_by("shingles", F.struct("size", "component")).alias("inside_shingles"),
        F.sum("size").alias("rows"),
        F.sum("shingles").alias("shingles"),
    ).where("inside < rows")
    top = top.select(
        "value",
        "top",
        blocks_of("inside", "inside_shingles").alias("inner"),
        F.greatest(F.ceil((F.col("rows") - F.col("inside")) / BLOCK_ROWS), F.ceil((F.col("shingles") - F.col("inside_shingles")) / BLOCK_SHINGLES)).cast("int").alias("outer"),
    )
    wide = wide.drop("rows", "blocks").join(top, "value")
    inside = F.col("component") == F.col("top")
    others = F.sequence(F.lit(0), F.col("outer") - 1)
    # blocks inside have numbers below -1
    members = wide.where(inside).select("value", F.explode(others).alias("one"), (-2 - dealt("inner", 3)).alias("two"), *CLASS)
    mine = wide.where(~inside).withColumn("b", dealt("outer", 4))
    to_inside = mine.select("value", F.col("b").alias("one"), F.explode(F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda x: -2 - x)).alias("two"), *CLASS)
    met = mine.select("value", "b", F.explode(others).alias("o"), *CLASS)
    among = met.select("value", F.least("b", "o").alias("one"), F.greatest("b", "o").alias("two"), *CLASS)
    return members.unionByName(to_inside).unionByName(among)


def met_links(meetings: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links within each meeting, in star form."""
    return (
        meetings.join(sets, CLASS)
        .select("value", "one", "two", "id", "shingles")
        .groupBy("value", "one", "two")
        .applyInArrow(block_links(similarity), LINKS)
        .distinct()
    )


def hot_links(hot: DataFrame, sets: DataFrame, known: DataFrame, similarity: int) -> DataFrame:
    """Links among documents that may meet in hot lists only, and those ``known`` from short ones.

    ``hot``: (value, rank, id, key, n, hot). Families are settled first, in a number
    of rows that grows with theirs; then only documents that they do not explain are
    compared with whole lists.
    """
    rows = write_clean(hot_rows(hot, similarity), "hot-rows")
    links = write_clean(known.unionByName(met_links(first_meetings(rows), sets, similarity)), "first-links")
    if rows.where("blocks > 1").isEmpty():
        return links
    rest = further_meetings(rows, connected_components(links))
    return links.unionByName(met_links(rest, sets, similarity))


def confirmed_links(docs: DataFrame, sketched: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links (u, v) between class representatives; ``sketched``: (id, key, n_shingles, sketch) of those."""
    posted = sketched.select(
        *CLASS, F.col("n_shingles").alias("n"), F.posexplode("sketch").alias("rank", "value")
    )
    lengths = posted.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    met = posted.join(lengths, "value")
    hot_count = met.groupBy(*CLASS).agg(F.sum((F.col("length") > LIST).cast("int")).alias("hot"))
    met = write_clean(met.join(hot_count, CLASS), "postings")
    short = met.where(F.col("length") <= LIST).drop("length")
    a, b = [short.select(*[F.col(c).alias(f"{c}_{x}" if c != "value" else c) for c in short.columns]) for x in "ab"]
    close = F.expr(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
    both_ways = ["id_a", "key_a", "id_b", "key_b"]
    pairs = (
        # classes of one id are one document already
        a.join(b, (a["value"] == b["value"]) & (F.col("id_a") < F.col("id_b")) & close)
        .groupBy(*both_ways)
        .agg(
            # ranks count from 0; both ascend with the hash, so sorting the sums keeps the order of the shared hashes
            F.sort_array(F.collect_list((F.col("rank_a") + F.col("rank_b") + 2).cast("int"))).alias("at"),
            F.first("n_a").alias("n_a"),
            F.first("n_b").alias("n_b"),
            F.least(F.first("hot_a"), F.first("hot_b")).alias("hot"),
        )
    )
    # the j-th shared hash stands at rank_a + rank_b - j of the union
    in_union = F.size(F.filter("at", lambda x, j: x - (j + 1) <= SKETCH))
    pairs = pairs.where(in_union + F.col("hot") >= needed(F.greatest("n_a", "n_b"), similarity)).select(*both_ways, "n_a", "n_b")
    pairs = write_clean(pairs, "pairs")
    in_hot = met.where(F.col("hot") >= needed(F.col("n"), similarity)).select("id")
    ids = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id")))
    sets = (
        docs.select(F.col("doc_id").alias("id"), "text")
        .join(ids.unionByName(in_hot).distinct(), "id", "left_semi")
        .mapInArrow(set_rows(width), SETS)
    )
    # written, so that texts are shuffled once for all that looks at sets
    sets = write_clean(sets, "sets")
    one, two = [sets.select(*[F.col(c).alias(f"{c}_{x}") for c in CLASS], F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    both = F.size(F.array_intersect("set_a", "set_b"))
    links = (
        pairs.join(one, ["id_a", "key_a"])
        .join(two, ["id_b", "key_b"])
        .withColumn("both", both)
        .where(f"100 * both >= {similarity} * (n_a + n_b - both)")
        .select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    )
    return hot_links(met.where(F.col("length") > LIST), sets, links, similarity)


def near_duplicates(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(docs.mapInArrow(sketch_rows(width, SKETCH), SKETCHED), "sketches")
    named = sketched.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("key1", "key2").agg(F.min("doc_id").alias("id"))
    members = named.select("doc_id", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "id")
    leads = named.join(classes.select("key1", "key2", "id"), ["key1", "key2"]).where("doc_id = id")
    leads = leads.select("id", F.col("key1").alias("key"), "n_shingles", "sketch").dropDuplicates(CLASS)
    links = confirmed_links(docs, leads, width, similarity)
    # rows that share an id tie their classes together
    ties = (
        members.groupBy("doc_id")
        .agg(F.min("id").alias("v"), F.max("id").alias("u"), F.collect_set("id").alias("ids"))
        .where("u > v")
        .select("v", F.explode("ids").alias("u"))
    )
    nodes = connected_components(links.unionByName(ties))
    labelled = classes.join(nodes.withColumnRenamed("node", "id"), "id", "left").select(
        "key1", "key2", F.coalesce("component", "id").alias("component")
    )
    return (
        sketched.select("doc_id", "n_shingles", "key1", "key2")
        .join(labelled, ["key1", "key2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by four-word shingles at a similarity of 0.8."""
    return near_duplicates(documents(spark, sf_dir), width=4, similarity=80)
