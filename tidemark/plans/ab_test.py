"""Champion against challenger on one test set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scoring import apply_scorer
from tidemark.operators.compare import COMPARED, DEFAULT_ALPHA, compare, decide
from tidemark.operators.metrics import confusion, evaluate
from tidemark.operators.registry import Registry
from tidemark.operators.resample import bootstrap_by_cells, replicate_scores, replicate_stats
from tidemark.plans.training import load_and_split
from tidemark.schema import CHALLENGER, CHAMPION, LABEL
from tidemark.session import materialize


@dataclass(frozen=True)
class AbResult:
    """Decision, both evaluation records, the comparison frame and the replicates
    (side, iter_id, F1, P, R) that it was made from."""

    should_deploy: bool
    champion: DataFrame
    challenger: DataFrame
    comparison: DataFrame
    replicates: DataFrame
    promoted: int | None = None


def bootstrap_summary(spark, cells: dict[str, int], iterations: int, seed: int) -> DataFrame:
    """Replicate statistics straight from the cells of one scorer."""
    counts = bootstrap_by_cells(spark, cells, iterations, seed)
    return replicate_stats(replicate_scores(counts), COMPARED)


def compare_cells(
    spark,
    base: dict[str, int],
    candidate: dict[str, int],
    iterations: int = 100,
    alpha: float = DEFAULT_ALPHA,
    seed: int = 42,
) -> DataFrame:
    """Comparison of two scorers given their confusion cells.

    Both sides use the same draws; the test treats them as independent.
    """
    return compare(
        bootstrap_summary(spark, base, iterations, seed),
        bootstrap_summary(spark, candidate, iterations, seed),
        alpha,
    )


def cells_of(scored: DataFrame) -> dict[str, int]:
    """The four confusion cells as numbers."""
    return confusion(scored).first().asDict()


def compare_scorers(test: DataFrame, base, candidate, threshold=None, **how) -> DataFrame:
    """Comparison of two models or score columns on the same rows."""
    spark = test.sparkSession
    sides = [cells_of(apply_scorer(test, scorer, threshold)) for scorer in (base, candidate)]
    return compare_cells(spark, *sides, **how)


def score_both(test: DataFrame, models) -> list[DataFrame]:
    """(label, score, prediction) of both models, from one pass over the rows."""
    names = (CHAMPION, CHALLENGER)
    both = test
    for name, model in zip(names, models):
        renamed = {"score": f"{name}_score", "prediction": f"{name}_prediction"}
        both = apply_scorer(both, model, threshold=None).withColumnsRenamed(renamed)
    both = both.select(LABEL, *[f"{n}_{c}" for n in names for c in ("score", "prediction")])
    stored = materialize(both, "scored")
    return [
        stored.select(LABEL, F.col(f"{n}_score").alias("score"), F.col(f"{n}_prediction").alias("prediction"))
        for n in names
    ]


def run_ab_test(
    spark: SparkSession,
    path: str,
    registry: Registry,
    model_name: str,
    declared: str = "auto",
    iterations: int = 100,
    alpha: float = DEFAULT_ALPHA,
    auto_deploy: bool = False,
    seed: int = 42,
) -> AbResult | None:
    """Test the challenger against the champion; None if either is missing.

    The split is keyed by transaction id, so the test side is the one the
    models were not trained on as long as the table holds the same rows.
    """
    models = [registry.load(model_name, alias) for alias in (CHAMPION, CHALLENGER)]
    if any(m is None for m in models):
        return None
    _, test, _ = load_and_split(spark, path, declared)
    scored = score_both(test, models)
    sides = []
    for name, cells in zip((CHAMPION, CHALLENGER), map(cells_of, scored), strict=True):
        scores = replicate_scores(bootstrap_by_cells(spark, cells, iterations, seed))
        sides.append(scores.select(F.lit(name).alias("side"), *scores.columns))
    replicates = materialize(sides[0].unionByName(sides[1]), "replicates")
    stats = [replicate_stats(replicates.filter(F.col("side") == name), COMPARED) for name in (CHAMPION, CHALLENGER)]
    comparison = materialize(compare(*stats, alpha), "comparison")
    decision = decide(comparison).first()
    promoted = None
    if decision.should_deploy and auto_deploy:
        promoted = registry.promote(model_name, f"won A/B test, F1 improvement {decision.improvement:+.4f}")
    return AbResult(decision.should_deploy, *[evaluate(s) for s in scored], comparison, replicates, promoted)
