"""The training job: load, split, fit, evaluate, store, register."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.calendar import add_features
from tidemark.functions.scoring import apply_scorer
from tidemark.operators.forest import DEFAULT_TRIALS, ForestParams, fit_forest, search_forest
from tidemark.operators.metrics import evaluation_record
from tidemark.operators.registry import Registry
from tidemark.operators.split import side, stratified_split
from tidemark.schema import LABEL, MODEL_FEATURES, WEIGHT
from tidemark.session import materialize
from tidemark.sources.files import batch_format, load_transactions
from tidemark.sources.models import save_model

MODES = ("baseline", "tuned")


@dataclass(frozen=True)
class TrainingResult:
    run_id: str
    params: ForestParams
    metrics: dict[str, float]
    version: int | None = None
    alias: str | None = None


def load_features(spark: SparkSession, path: str, declared: str = "auto") -> DataFrame:
    """Cleaned input with features.

    Text is parsed and cleaned once and kept as Parquet; the passes that follow
    then read only the columns they use.
    """
    features = add_features(load_transactions(spark, path, declared))
    return materialize(features, "features") if batch_format(path, declared) == "txt" else features


def load_and_split(spark: SparkSession, path: str, declared: str = "auto", **how) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train side, test side and the feature list, ready for models."""
    split = stratified_split(load_features(spark, path, declared), **how)
    return side(split, "train"), side(split, "test"), list(MODEL_FEATURES)


def choose_params(train: DataFrame, mode: str, trials: int = DEFAULT_TRIALS) -> tuple[ForestParams, float | None]:
    """Baseline settings, or the best of a search with its validation score."""
    if mode not in MODES:
        raise ValueError(f"unknown training mode {mode!r}, expected one of {MODES}")
    if mode == "baseline":
        return ForestParams(), None
    params, score, _ = search_forest(train, trials=trials)
    return params, score


def train_model(
    spark: SparkSession,
    path: str,
    output: str,
    declared: str = "auto",
    mode: str = "baseline",
    trials: int = DEFAULT_TRIALS,
    registry: Registry | None = None,
    model_name: str | None = None,
) -> TrainingResult:
    """Run the whole job; registers the model when a registry is given and a
    model name with it, otherwise only logs the run."""
    train, test, _ = load_and_split(spark, path, declared)
    params, best = choose_params(train, mode, trials)
    model, weights = fit_forest(train, params)
    metrics = evaluation_record(apply_scorer(test, model, threshold=None))
    save_model(model, output)

    run_id = uuid.uuid4().hex
    version = alias = None
    if registry is not None:
        logged = {
            **params.as_dict(),
            "target_col": LABEL,
            "feature_cols": ",".join(MODEL_FEATURES),
            "weight_col": WEIGHT,
            "model_type": "RandomForestClassifier",
            "train_mode": mode,
        }
        figures = {f"train_class_{c}_{what}": getattr(weights, f"{what}_{c}") for c in (0, 1) for what in ("count", "weight")}
        if best is not None:
            figures["best_validation_fraud_f1"] = best
        registry.log_run(run_id, logged, {**figures, **metrics})
        if model_name:
            note = f"{mode}: fraud_f1={metrics['fraud_f1']:.4f}, auc={metrics['auc']:.4f}, params={params.as_dict()}"
            version, alias = registry.register(model_name, output, run_id, note)
    return TrainingResult(run_id, params, metrics, version, alias)
