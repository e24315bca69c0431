"""Class balance and balancing weights."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import LABEL, WEIGHT


@dataclass(frozen=True)
class ClassWeights:
    """Row counts of both classes and the weight that evens them out."""

    count_0: int
    count_1: int
    weight_0: float
    weight_1: float

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


def class_counts(df: DataFrame, by=(LABEL,)) -> DataFrame:
    """Rows per class: the balance profile."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def measure_weights(df: DataFrame, label: str = LABEL) -> ClassWeights:
    """Weights ``total / (2 * rows of class)`` from one aggregate row."""
    n = df.agg(
        F.count_if(F.col(label) == 0).alias("zeros"),
        F.count_if(F.col(label) == 1).alias("ones"),
    ).first()
    if not n.zeros or not n.ones:
        raise ValueError(f"both classes of {label} must be present, got {n.zeros} zeros and {n.ones} ones")
    total = n.zeros + n.ones
    return ClassWeights(n.zeros, n.ones, total / (2.0 * n.zeros), total / (2.0 * n.ones))


def add_class_weights(
    df: DataFrame,
    label: str = LABEL,
    weight: str = WEIGHT,
) -> tuple[DataFrame, ClassWeights]:
    """``df`` with a weight column, and the figures behind it.

    The two weights enter the plan as literals, so no row is shuffled.
    """
    w = measure_weights(df, label)
    column = F.when(F.col(label) == 1, F.lit(w.weight_1)).otherwise(F.lit(w.weight_0))
    return df.withColumn(weight, column), w


def weight_table(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row with both counts and weights, as a lazy aggregate."""
    zeros, ones = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    counted = df.agg(zeros.alias("count_0"), ones.alias("count_1"))
    total = F.col("count_0") + F.col("count_1")
    return counted.select(
        "*",
        *[F.try_divide(total, F.lit(2.0) * F.col(f"count_{c}")).alias(f"weight_{c}") for c in (0, 1)],
    )
