"""Run log, model versions and aliases as append-only tables.

An alias points to the version of its latest event; nothing is updated in
place. Versions and aliases change by commits: numbered files that are created only
if their number is free. Who finds it taken reads what the other one wrote, decides
anew and takes the next number, so any number of writers see one order of events.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import CHALLENGER, CHAMPION
from tidemark.sources.models import load_model
from tidemark.sources.paths import publish_new

RUN_SCHEMA = "run_id string, kind string, name string, value string"
#: a commit adds versions and alias events; the events' number is the commit's
COMMIT_SCHEMA = (
    "number long, versions array<struct<model: string, version: long, path: string, run_id: string, description: string>>, "
    "aliases array<struct<model: string, alias: string, version: long, description: string>>"
)


def run_rows(run_id: str, params: Mapping, metrics: Mapping) -> list[tuple]:
    """Long form: one row per parameter and per metric."""
    return [(run_id, "param", k, str(v)) for k, v in params.items()] + [
        (run_id, "metric", k, repr(float(v))) for k, v in metrics.items()
    ]


def pivot_runs(log: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """One row per run with the named metrics as columns.

    A metric is logged once per run. Naming the metrics spares the pass that
    would look for the distinct names.
    """
    values = log.filter(F.col("kind") == "metric").groupBy("run_id").pivot("name", list(metrics))
    return values.agg(F.max(F.col("value").cast("double")))


def current_aliases(events: DataFrame) -> DataFrame:
    """(model, alias, version, event_seq): the latest event of each alias."""
    latest = F.max_by("version", "event_seq").alias("version")
    return events.groupBy("model", "alias").agg(latest, F.max("event_seq").alias("event_seq"))


def alias_registrations(registrations: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Alias events for new versions (model, version, event_seq).

    The first version of a model without a champion becomes champion, every
    other one challenger. Per-model facts are aggregated before the join, so a
    model with very many versions is split by AQE's skew handling.
    """
    first = registrations.groupBy("model").agg(F.min("event_seq").alias("first_seq"))
    if events is not None:
        led = events.filter(F.col("alias") == CHAMPION).select("model").distinct()
        first = first.join(led, "model", "left_anti")
    judged = registrations.join(first, "model", "left")
    opens = F.coalesce(F.col("event_seq") == F.col("first_seq"), F.lit(False))
    return judged.select(
        "model",
        F.when(opens, CHAMPION).otherwise(CHALLENGER).alias("alias"),
        "version",
        "event_seq",
    )


def promotions(aliases: DataFrame, winners: DataFrame, event_seq) -> DataFrame:
    """Alias events that make the current challenger of each winner champion."""
    challengers = aliases.filter(F.col("alias") == CHALLENGER)
    named = winners.select("model").distinct()
    return challengers.join(named, "model", "left_semi").select(
        "model", F.lit(CHAMPION).alias("alias"), "version", F.lit(event_seq).cast("long").alias("event_seq")
    )


def _versions(commits: DataFrame) -> DataFrame:
    return commits.select(F.inline("versions"))


def _alias_events(commits: DataFrame) -> DataFrame:
    events = commits.select("number", F.inline("aliases"))
    return events.select("model", "alias", "version", F.col("number").alias("event_seq"), "description")


def _resolved(events: DataFrame, model: str, alias: str) -> int | None:
    named = (F.col("model") == model) & (F.col("alias") == alias)
    found = current_aliases(events.filter(named)).first()
    return None if found is None else found.version


def _event(model: str, alias: str, version: int, description: str) -> dict:
    return {"model": model, "alias": alias, "version": version, "description": description}


class Registry:
    """The run log and the commits below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _found(self, reader, name: str, schema: str) -> DataFrame:
        try:
            return reader(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def runs(self) -> DataFrame:
        return self._found(self.spark.read.schema(RUN_SCHEMA).parquet, "runs", RUN_SCHEMA)

    @property
    def commits(self) -> DataFrame:
        return self._found(self.spark.read.schema(COMMIT_SCHEMA).json, "commits", COMMIT_SCHEMA)

    @property
    def versions(self) -> DataFrame:
        return _versions(self.commits)

    @property
    def aliases(self) -> DataFrame:
        return _alias_events(self.commits)

    def _commit(self, decide: Callable[[DataFrame], dict | None]) -> dict | None:
        """Add what ``decide`` makes of all commits so far; None if it has nothing to add.

        It is asked again whenever another writer was faster.
        """
        while True:
            commits = self.commits
            decided = decide(commits)
            if decided is None:
                return None
            number = (commits.agg(F.max("number")).first()[0] or 0) + 1
            text = json.dumps({"number": number, **decided}) + "\n"
            if publish_new(self.spark, text, f"{self.root}/commits/{number:012d}.json"):
                return decided

    def log_run(self, run_id: str, params: Mapping, metrics: Mapping) -> None:
        rows = self.spark.createDataFrame(run_rows(run_id, params, metrics), RUN_SCHEMA).coalesce(1)
        rows.write.mode("append").parquet(f"{self.root}/runs")

    def resolve(self, model: str, alias: str) -> int | None:
        """Version an alias points to, or None."""
        return _resolved(self.aliases, model, alias)

    def set_alias(self, model: str, version: int, alias: str, description: str = "") -> None:
        self._commit(lambda _: {"aliases": [_event(model, alias, version, description)]})

    def register(self, model: str, path: str, run_id: str = "", description: str = "") -> tuple[int, str]:
        """Add a version; returns it with the alias it was given."""

        def decide(commits: DataFrame) -> dict:
            last = _versions(commits).filter(F.col("model") == model).agg(F.max("version")).first()[0]
            version = (last or 0) + 1
            new = self.spark.createDataFrame([(model, version, 0)], "model string, version long, event_seq long")
            alias = alias_registrations(new, _alias_events(commits)).first().alias
            added = {"model": model, "version": version, "path": path, "run_id": run_id, "description": description}
            return {"versions": [added], "aliases": [_event(model, alias, version, description)]}

        event = self._commit(decide)["aliases"][0]
        return event["version"], event["alias"]

    def promote(self, model: str, description: str = "") -> int | None:
        """Make the challenger champion; None if there is no challenger."""

        def decide(commits: DataFrame) -> dict | None:
            version = _resolved(_alias_events(commits), model, CHALLENGER)
            return None if version is None else {"aliases": [_event(model, CHAMPION, version, description)]}

        done = self._commit(decide)
        return None if done is None else done["aliases"][0]["version"]

    def load(self, model: str, alias: str = CHAMPION) -> PipelineModel | None:
        """The model an alias points to, or None."""
        version = self.resolve(model, alias)
        if version is None:
            return None
        row = self.versions.filter((F.col("model") == model) & (F.col("version") == version)).first()
        return load_model(row.path)
