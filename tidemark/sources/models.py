"""Fitted pipelines as files."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str) -> str:
    """Write a fitted pipeline, replacing what is there."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_columns(model: PipelineModel) -> list[str]:
    """The columns a fitted pipeline was trained on, as stored with it."""
    return list(model.stages[0].getInputCols())
