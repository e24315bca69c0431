"""Evaluation of scored transactions as aggregates.

Scored frames hold the label, ``score`` and a 0/1 ``prediction``. One pass
groups them by score; every metric is a sum over those groups. Counts and the
sum below the ROC curve stay whole numbers until the last division, so they do not
depend on the order in which partitions are added up; the sum below the precision
curve is one of doubles, and may differ in its last digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import block_offsets
from tidemark.schema import LABEL

CELLS = ("tp", "fp", "tn", "fn")
EVALUATION = ("auc", "pr_auc", "accuracy", "f1", "fraud_precision", "fraud_recall") + CELLS
#: products of two row counts need more than 64 bits
WIDE = "decimal(38,0)"
#: rows whose scores one block of the curve holds, and most blocks
ROWS_PER_BLOCK, MOST_BLOCKS = 500_000, 256


def cell_counts(label: str = LABEL, prediction: str = "prediction") -> dict[str, Column]:
    """The four confusion cells as aggregate expressions."""
    y, p = F.col(label), F.col(prediction)
    return {
        "tp": F.count_if((y == 1) & (p == 1)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "tn": F.count_if((y == 0) & (p == 0)),
        "fn": F.count_if((y == 1) & (p == 0)),
    }


def _aliased(expressions: dict[str, Column]) -> list[Column]:
    return [expr.alias(name) for name, expr in expressions.items()]


def ratio(part: Column, whole: Column) -> Column:
    """A share, 0 where there is nothing to share."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def harmonic(p: Column, r: Column) -> Column:
    """F1 of a precision and a recall, 0 where both are 0."""
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """One row: tp, fp, tn, fn, in a single aggregate."""
    return scored.agg(*_aliased(cell_counts(label, prediction)))


def with_rates(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 of class 1 beside the cells."""
    rated = cells.withColumns({"fraud_precision": precision(), "fraud_recall": recall()})
    return rated.withColumn("fraud_f1", harmonic(F.col("fraud_precision"), F.col("fraud_recall")))


def _all_counts(label: str, prediction: str) -> dict[str, Column]:
    """Cells plus what other label values need: they count, but never match."""
    return {
        "rows": F.count(F.lit(1)),
        "pos": F.count_if(F.col(label) > 0.5),
        "flagged": F.count_if(F.col(prediction) == 1),
        **cell_counts(label, prediction),
    }


def _accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("rows"))


def _weighted_f1() -> Column:
    """F1 per class, weighted by how often the class really occurs."""
    ones, zeros = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    f1_one = ratio(F.lit(2.0) * F.col("tp"), ones + F.col("flagged"))
    f1_zero = ratio(F.lit(2.0) * F.col("tn"), zeros + F.col("rows") - F.col("flagged"))
    return ratio(ones * f1_one + zeros * f1_zero, F.col("rows"))


def class_scores(scored: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and support-weighted F1."""
    counts = scored.agg(*_aliased(_all_counts(label, prediction)))
    return counts.select(_accuracy().alias("accuracy"), _weighted_f1().alias("f1"))


def score_cuts(scored: DataFrame) -> list[float]:
    """Ascending scores that cut the rows into blocks of about equal size; none for few rows.

    They only deal out the work: approximate quantiles are as good as exact ones.
    """
    shares = [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)]
    found = scored.agg(F.count("score"), F.percentile_approx(F.col("score").cast("double"), shares)).first()
    step = MOST_BLOCKS / min(MOST_BLOCKS, max(1, -(-found[0] // ROWS_PER_BLOCK)))
    cuts = [] if not found[1] else [found[1][max(0, round(i * step) - 1)] for i in range(1, round(MOST_BLOCKS / step))]
    return sorted({c for c in cuts if not math.isnan(c)})


def score_block(cuts: list[float]) -> Column:
    """Block of a score, the highest ones first: a function of the score alone. Null is below all."""
    score = F.col("score")
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: score < cut))
    return F.when(score.isNull(), F.lit(len(cuts) + 1)).otherwise(above)


def score_curve(scored: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """One row per distinct score with its counts and those of all higher scores.

    A continuous score has nearly as many groups as rows, so the running sums
    are taken per block of scores and shifted by the sums of earlier blocks.
    As the block follows from the score, nothing needs to be written: the groups
    are shuffled once more, by block. A score that many rows share is one group.
    """
    cuts = score_cuts(scored)
    grouped = scored.groupBy("score").agg(*_aliased(_all_counts(label, prediction)))
    none = F.lit(0).cast("long")
    if cuts:
        placed = grouped.withColumn("block", score_block(cuts))
        # at most MOST_BLOCKS + 1 rows
        offsets = block_offsets(placed, _pos=F.sum("pos"), _rows=F.sum("rows"))
        placed = placed.join(F.broadcast(offsets), "block")
        block = [F.col("block")]
    else:
        placed, block = grouped.select("*", none.alias("_pos"), none.alias("_rows")), []
    earlier = Window.partitionBy(*block).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        *grouped.columns,
        (F.col("_pos") + F.coalesce(F.sum("pos").over(earlier), none)).alias("pos_above"),
        (F.col("_rows") + F.coalesce(F.sum("rows").over(earlier), none)).alias("rows_above"),
    )


def area_sums() -> dict[str, Column]:
    """Aggregates over :func:`score_curve` from which both areas follow."""
    neg = (F.col("rows") - F.col("pos")).cast("decimal(19,0)")
    height = (F.col("pos_above") * 2 + F.col("pos")).cast("decimal(19,0)")
    here = (F.col("pos_above") + F.col("pos")) / (F.col("rows_above") + F.col("rows"))
    before = F.when(F.col("rows_above") > 0, F.col("pos_above") / F.col("rows_above")).otherwise(here)
    return {
        "roc_sum": F.sum((neg * height).cast(WIDE)),
        "pr_sum": F.sum(F.col("pos") * (here + before)),
    }


def _roc_area() -> Column:
    """Trapezoids between distinct scores; the ends are fixed where a class is absent."""
    pos, neg = F.col("pos"), F.col("rows") - F.col("pos")
    whole = pos.cast("double") * neg.cast("double") * F.lit(2.0)
    return (
        F.when(neg == 0, F.lit(1.0)).when(pos == 0, F.lit(0.0)).otherwise(F.col("roc_sum").cast("double") / whole)
    )


def _pr_area() -> Column:
    return F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(F.col("pr_sum") / (F.lit(2.0) * F.col("pos")))


def evaluate(scored: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """One row with the ten evaluation metrics and the F1 of class 1."""
    curve = score_curve(scored, label, prediction)
    names = ("rows", "pos", "flagged") + CELLS
    sums = curve.agg(*_aliased(area_sums()), *[F.sum(n).alias(n) for n in names])
    record = sums.select(
        _roc_area().alias("auc"),
        _pr_area().alias("pr_auc"),
        _accuracy().alias("accuracy"),
        _weighted_f1().alias("f1"),
        precision().alias("fraud_precision"),
        recall().alias("fraud_recall"),
        *CELLS,
    )
    return record.withColumn("fraud_f1", harmonic(F.col("fraud_precision"), F.col("fraud_recall")))


def evaluation_record(scored: DataFrame, **columns) -> dict[str, float]:
    """:func:`evaluate` as a plain mapping of floats."""
    return {k: float(v) for k, v in evaluate(scored, **columns).first().asDict().items()}
