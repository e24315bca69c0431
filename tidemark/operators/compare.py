"""Welch comparison of two sets of bootstrap replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.student import two_sided_p

DEFAULT_ALPHA = 0.01
DECIDING_METRIC = "F1"
COMPARED = ("F1", "P")
NAN = float("nan")


def paired_stats(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both sides' (n, mean, variance) on one row per metric."""

    def named(stats: DataFrame, side: str) -> DataFrame:
        return stats.select("metric", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "mean", "variance")])

    return named(base, "base").join(named(candidate, "candidate"), "metric")


def _squared_errors() -> tuple[Column, Column]:
    return (
        F.col("base_variance") / F.col("base_n"),
        F.col("candidate_variance") / F.col("candidate_n"),
    )


def welch_t() -> Column:
    """Difference of means over its standard error.

    Without any variance the difference is certain: infinite, or unknown when
    the means agree as well. Fewer than two replicates give an unknown t.
    """
    base, candidate = _squared_errors()
    error2, gap = base + candidate, F.col("base_mean") - F.col("candidate_mean")
    return (
        F.when(error2.isNull(), F.lit(NAN))
        .when(error2 > 0, gap / F.sqrt(error2))
        .when(gap > 0, F.lit(float("inf")))
        .when(gap < 0, F.lit(float("-inf")))
        .otherwise(F.lit(NAN))
    )


def welch_df() -> Column:
    """Welch-Satterthwaite degrees of freedom; 1 where there is no variance."""
    base, candidate = _squared_errors()
    spread = base * base / (F.col("base_n") - 1) + candidate * candidate / (F.col("candidate_n") - 1)
    return F.when(base + candidate > 0, (base + candidate) * (base + candidate) / spread).otherwise(F.lit(1.0))


def effect_size() -> Column:
    """Distance of the means in pooled standard deviations."""
    pooled = F.sqrt((F.col("base_variance") + F.col("candidate_variance")) / 2)
    gap = F.abs(F.col("candidate_mean") - F.col("base_mean"))
    return F.when((pooled > 0) & ~F.isnan(pooled), gap / pooled).otherwise(F.lit(0.0))


def verdict() -> Column:
    """The finding in a word."""
    return (
        F.when(~F.col("is_significant"), "not significant")
        .when(F.col("improvement") > 0, "better")
        .when(F.col("improvement") < 0, "worse")
        .otherwise("different")
    )


def compare(
    base: DataFrame,
    candidate: DataFrame,
    alpha: float = DEFAULT_ALPHA,
    metrics=COMPARED,
) -> DataFrame:
    """One row per metric: test, effect size, means and verdict.

    Takes two frames of :func:`resample.replicate_stats`. The replicates are
    the sample, so p shrinks as their number grows.
    """
    rows = paired_stats(base, candidate).filter(F.col("metric").isin(*metrics))
    tested = rows.withColumns({"t_statistic": welch_t(), "degrees": welch_df()})
    tested = tested.withColumn("p_value", two_sided_p(F.col("t_statistic"), F.col("degrees")))
    judged = tested.withColumns(
        {
            "effect_size": effect_size(),
            "is_significant": F.col("p_value") < F.lit(float(alpha)),
            "improvement": F.col("candidate_mean") - F.col("base_mean"),
        }
    )
    return judged.select(
        "metric",
        "t_statistic",
        "degrees",
        "p_value",
        "effect_size",
        "is_significant",
        "base_mean",
        "candidate_mean",
        "improvement",
        verdict().alias("verdict"),
    )


def decide(comparison: DataFrame) -> DataFrame:
    """One row: deploy if the deciding metric is significantly better."""
    return comparison.filter(F.col("metric") == DECIDING_METRIC).select(
        (F.col("is_significant") & (F.col("improvement") > 0)).alias("should_deploy"),
        "improvement",
    )
