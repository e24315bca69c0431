"""Exact, repeatable stratified split.

Every row has a keyed pseudo-random text (see ``functions.keys``); each class
sends its ``quota`` smallest ones to train. The quota-th smallest is found by
counting: per round one partial aggregate over the next three hex digits, at
most 4096 groups per class. The split itself is then a comparison of each
row with the cut of its class: no window over a class and no shuffle of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import row_hash, row_key
from tidemark.schema import LABEL

#: hex digits read per counting round
DIGITS = 3
#: once the groups around the cuts are this small they are listed by value
LIST_LIMIT = 50_000
#: what is known of so many classes goes into the plan as literals; beyond that it is a
#: table, which up to BROADCAST_CLASSES rows is broadcast, and joined if larger
LITERAL_CLASSES, BROADCAST_CLASSES = 50, 1_000
KEY_LENGTH, HASH_LENGTH = 32, 16
TRAIN, TEST = "train", "test"
#: sorts before every key: the cut of a class that sends nothing to train
NOTHING = ""


@dataclass(frozen=True)
class ClassCut:
    """Where one class is cut: keys up to ``key`` are train.

    If rows share that key, ``tie`` bounds their row hash as well. ``ties``
    rows equal the cut in all of it, i.e. are copies of one row, and
    ``ties_in_train`` of them belong to train.
    """

    label: int
    rows: int
    quota: int
    key: str
    tie: str | None = None
    ties: int = 1
    ties_in_train: int = 1

    @property
    def divides_copies(self) -> bool:
        return self.ties_in_train < self.ties


@dataclass(frozen=True)
class SplitPlan:
    """All cuts of a split; small, and valid for any layout of the same rows."""

    label: str
    key: str
    seed: int
    cuts: tuple[ClassCut, ...]


def quota(rows: Column, fraction: float) -> Column:
    """Train rows of a class: floor of the share, but at least one on each side."""
    share = F.floor(rows * F.lit(float(fraction)))
    return F.least(F.greatest(share, F.lit(1)), rows - 1).cast("long")


def split_number(df: DataFrame, seed: int, key: str) -> Column:
    """The random key of a row; without an id column, of the row as a whole."""
    return row_key(seed, F.col(key) if key in df.columns else row_hash(df.columns))


def _of_class(df: DataFrame, label: Column, rows: list[tuple], **kinds: str) -> DataFrame:
    """``df`` with what ``rows`` (label, values) say of each row's class; rows of other classes go.

    ``kinds`` names the values and their types.
    """
    if len(rows) <= LITERAL_CLASSES:
        known = df.filter(label.isin([r[0] for r in rows]))
        added = {}
        for place, (name, kind) in enumerate(kinds.items(), 1):
            value = F.lit(None)
            for row in rows:
                value = F.when(label == row[0], F.lit(row[place])).otherwise(value)
            added[name] = value.cast(kind)
        return known.withColumns(added)
    schema = ", ".join(f"{name} {kind}" for name, kind in {"_label": "int", **kinds}.items())
    table = df.sparkSession.createDataFrame(rows, schema)
    table = F.broadcast(table) if len(rows) <= BROADCAST_CLASSES else table
    return df.join(table, label == F.col("_label")).drop("_label")


def _at_rank(counts: DataFrame, value: str) -> DataFrame:
    """Per class the value at which the running count reaches ``k``."""
    upto = Window.partitionBy("label").orderBy(value)
    running = counts.withColumn("upto", F.sum("n").over(upto))
    return running.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))


def _narrow(values: DataFrame, state: list[tuple], known: int) -> DataFrame:
    told = _of_class(values, F.col("label"), [s[:3] for s in state], prefix="string", k="long")
    return told.filter(F.substring("v", 1, known) == F.col("prefix"))


def _kth_smallest(values: DataFrame, state: list[tuple], known: int, length: int) -> dict[int, tuple[str, int, int]]:
    """Per class the k-th smallest of a fixed-length hex column ``v``.

    ``state`` rows are (label, prefix, k, n): the ``known`` leading digits,
    and the rank still to find among the ``n`` rows that share them. Returns
    label -> (value, rank among equals, number of equals).
    """
    while known < length and max(n for *_, n in state) > LIST_LIMIT:
        step = min(DIGITS, length - known)
        counts = (
            _narrow(values, state, known)
            .groupBy("label", "prefix", "k", F.substring("v", known + 1, step).alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        hits = _at_rank(counts, "digit").collect()
        state = [(r.label, r.prefix + r.digit, r.k - (r.upto - r.n), r.n) for r in hits]
        known += step
    if known == length:
        return {label: (prefix, k, n) for label, prefix, k, n in state}
    counts = _narrow(values, state, known).groupBy("label", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    hits = _at_rank(counts, "v").collect()
    return {r.label: (r.v, r.k - (r.upto - r.n), r.n) for r in hits}


def plan_split(
    df: DataFrame,
    label: str = LABEL,
    fraction: float = 0.8,
    seed: int = 42,
    key: str = "transaction_id",
) -> SplitPlan:
    """Find the cut of every class; raises if class 0 or 1 has under two rows.

    Reads only label and key column, usually twice. Further passes happen only
    where many rows share a key, down to copies of a single row. One row per
    class comes to the driver.
    """
    values = df.select(F.col(label).cast("int").alias("label"), split_number(df, seed, key).alias("v"))
    counts = values.groupBy("label", F.substring("v", 1, DIGITS).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    sized = counts.withColumn("rows", F.sum("n").over(Window.partitionBy("label")))
    sized = sized.withColumn("k", quota(F.col("rows"), fraction))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("digit"))
    sized = sized.withColumn("upto", upto)
    # a class of one row has k = 0 and is reported with its only digit
    at_cut = (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.greatest("k", F.lit(1)))
    found = sized.filter(at_cut).collect()
    sizes = {r.label: r.rows for r in found}
    if any(sizes.get(c, 0) < 2 for c in (0, 1)):
        held = {c: sizes.get(c, 0) for c in (0, 1)}
        raise ValueError(f"a split needs two rows in class 0 and 1, {label} has {held}")

    cuts = {r.label: ClassCut(r.label, r.rows, 0, NOTHING) for r in found if r.k == 0}
    quotas = {r.label: r.k for r in found if r.k > 0}
    state = [(r.label, r.digit, r.k - (r.upto - r.n), r.n) for r in found if r.k > 0]
    for c, (value, rank, equal) in _kth_smallest(values, state, DIGITS, KEY_LENGTH).items():
        cuts[c] = ClassCut(c, sizes[c], quotas[c], value, ties=equal, ties_in_train=rank)
    shared = {c: cut for c, cut in cuts.items() if cut.divides_copies}
    if shared:
        cuts.update(_cut_shared_keys(df, label, seed, key, shared))
    return SplitPlan(label, key, seed, tuple(cuts[c] for c in sorted(cuts)))


def _cut_shared_keys(df, label, seed, key, shared: dict[int, ClassCut]) -> dict[int, ClassCut]:
    """Order rows that share the cut key by a hash of the whole row."""
    numbered = df.select(
        F.col(label).cast("int").alias("label"),
        split_number(df, seed, key).alias("key"),
        row_hash(df.columns).alias("v"),
    )
    at_cut = [(c, cut.key) for c, cut in shared.items()]
    values = _of_class(numbered, F.col("label"), at_cut, cut="string").filter("key = cut")
    state = [(c, "", cut.ties_in_train, cut.ties) for c, cut in shared.items()]
    found = _kth_smallest(values, state, 0, HASH_LENGTH)
    return {
        c: ClassCut(c, shared[c].rows, shared[c].quota, shared[c].key, value, equal, rank)
        for c, (value, rank, equal) in found.items()
    }


def apply_split(df: DataFrame, plan: SplitPlan) -> DataFrame:
    """Add ``split``: train or test. A projection; the cuts of up to LITERAL_CLASSES classes are in the plan."""
    cuts = [(c.label, c.key, c.tie, c.divides_copies) for c in plan.cuts]
    label = F.col(plan.label).cast("int")
    looked_up = _of_class(df, label, cuts, _cut="string", _tie="string", _divide="boolean")
    number = split_number(df, plan.seed, plan.key)
    if all(c.tie is None for c in plan.cuts):
        in_train = number <= F.col("_cut")
    else:
        tied = F.col("_tie").isNull() | (row_hash(df.columns) <= F.col("_tie"))
        in_train = (number < F.col("_cut")) | ((number == F.col("_cut")) & tied)
    marker = F.when(in_train, TRAIN).otherwise(TEST).alias("split")
    if not any(c.divides_copies for c in plan.cuts):
        return looked_up.select(*df.columns, marker)

    copies = F.col("_divide") & (number == F.col("_cut")) & (row_hash(df.columns) == F.col("_tie"))
    rest = looked_up.filter(~copies).select(*df.columns, marker)
    return rest.unionByName(_divide_copies(looked_up.filter(copies).select(*df.columns), plan))


def _divide_copies(copies: DataFrame, plan: SplitPlan) -> DataFrame:
    """Deal copies of one row to both sides, exactly and without gathering them.

    Copies are interchangeable, so they are counted per input partition; the
    running count over partitions says how many of each partition go to train,
    and the counted rows are written out again from there.
    """
    want = [(c.label, c.ties_in_train) for c in plan.cuts if c.divides_copies]
    origin = copies.withColumn("_origin", F.spark_partition_id())
    counted = origin.groupBy(*copies.columns, "_origin").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(plan.label).orderBy("_origin").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        _of_class(counted, F.col(plan.label).cast("int"), want, _want="long")
        .withColumn("_left", F.col("_want") - F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    )
    marker = F.when(F.col("_copy") <= F.col("_left"), TRAIN).otherwise(TEST)
    return dealt.select(*copies.columns, marker.alias("split"))


def stratified_split(df: DataFrame, **how) -> DataFrame:
    """``df`` with a ``split`` column; see :func:`plan_split` for options."""
    return apply_split(df, plan_split(df, **how))


def side(split: DataFrame, name: str) -> DataFrame:
    """One side of a split frame without the marker column."""
    return split.filter(F.col("split") == name).drop("split")


def train_test(df: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    split = stratified_split(df, **how)
    return side(split, TRAIN), side(split, TEST)


def validation_split(train: DataFrame, valid_fraction: float = 0.2, seed: int = 42, salt: int = 1, **how) -> DataFrame:
    """Nested split of a train side, dealt independently of the outer one."""
    return stratified_split(train, fraction=1.0 - valid_fraction, seed=seed + salt, **how)
