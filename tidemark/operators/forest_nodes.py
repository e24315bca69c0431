"""A stored forest as a table of nodes, and scores by walking it.

This needs no model object: the nodes are read from the stored pipeline, so scores
can be made and checked wherever the table can be read. Rows are put into blocks, a
block is joined with the trees, and all its rows walk a tree at once in numpy, so the
trees are copied for a block and not for a row. Trees are packed into groups of
bounded size. One group, as forests of the default size are, adds no shuffle and
works on streams; with more, each block meets every group once and the groups' votes
are added up.

Streams of many rows are scored by :func:`score_forest_rows`: the trees go to the
workers once, and whole batches of rows take a level of a tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scoring import apply_scorer, flag
from tidemark.session import scratch_path
from tidemark.sources.models import feature_columns, save_model

#: nodes of a group of trees (some 40 bytes each)
NODES_PER_GROUP = 1_000_000
#: nodes that are sent to all tasks; a larger forest is joined by shuffle
NODES_BROADCAST = 4_000_000

TREE = ("feature", "threshold", "left", "right", "zeros", "ones")


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the forest of a stored pipeline.

    tree, node; feature, threshold, left and right (-1 at leaves); zeros and ones,
    the shares of the classes among the training weight that reached the node.
    """
    stored = spark.read.parquet(f"{path}/stages/1_*/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    weight = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return stored.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.col("split.featureIndex").alias("feature"),
        F.coalesce(F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)), F.lit(0.0)).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.when(weight > 0, stats[0] / weight).otherwise(0.0).alias("zeros"),
        F.when(weight > 0, stats[1] / weight).otherwise(0.0).alias("ones"),
    )


def packed_trees(nodes: DataFrame) -> DataFrame:
    """(group, trees): arrays by node number for each tree, trees in order."""
    at = F.array_sort(F.collect_list(F.struct("node", *TREE)))
    trees = nodes.groupBy("tree").agg(at.alias("at"), F.count("*").alias("size"))
    before = Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)  # a row per tree
    group = F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / NODES_PER_GROUP).cast("int")
    # a field of an array of structs is the array of the field
    arrays = F.struct("tree", *[F.col(f"at.{c}").alias(c) for c in TREE])
    packed = trees.withColumn("group", group).select("group", arrays.alias("one"))
    return packed.groupBy("group").agg(F.array_sort(F.collect_list("one")).alias("trees"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch: its rows as an array."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, batch.num_rows], rows)], ["block"])


def _leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row of features comes to."""
    node = np.zeros(len(x), dtype=np.int64)
    inner = np.arange(len(x)) if tree["left"][0] >= 0 else np.zeros(0, dtype=np.int64)
    while len(inner):
        at = node[inner]
        goes_left = x[inner, tree["feature"][at]] <= tree["threshold"][at]
        at = node[inner] = np.where(goes_left, tree["left"][at], tree["right"][at])
        inner = inner[tree["left"][at] >= 0]
    return node


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block with the votes of the trees it was joined with, added in the order of the trees."""
    for batch in batches:
        blocks, groups = batch.column("block"), batch.column("trees")
        for i in range(batch.num_rows):
            rows = pa.RecordBatch.from_struct_array(blocks[i].values)
            x = rows.column("_x").flatten().to_numpy().reshape(rows.num_rows, -1)
            zeros, ones = np.zeros(len(x)), np.zeros(len(x))
            trees = groups[i].values
            parts = {c: trees.field(c) for c in TREE}
            for t in range(len(trees)):
                tree = {c: part[t].values.to_numpy(zero_copy_only=False) for c, part in parts.items()}
                leaf = _leaves(tree, x)
                zeros += tree["zeros"][leaf]
                ones += tree["ones"][leaf]
            kept = [c for c in rows.schema.names if c != "_x"]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(zeros), pa.array(ones)], [*kept, "_zeros", "_ones"])


def score_by_nodes(df: DataFrame, nodes: DataFrame, features, threshold: float = 0.5) -> DataFrame:
    """``df`` with the ``score`` and ``prediction`` that the forest of ``nodes`` gives.

    Rows with a null or NaN feature are left out, as by the pipeline.
    """
    size = nodes.count()
    packed = packed_trees(nodes)
    groups = packed.agg(F.max("group")).first()[0] + 1
    packed = F.broadcast(packed) if size <= NODES_BROADCAST else packed
    values = F.array(*[F.col(c).cast("double") for c in features])
    whole = df.withColumn("_x", values).where(~F.exists("_x", lambda x: x.isNull() | F.isnan(x)))
    if groups > 1:
        whole = whole.withColumn("_row", F.struct(F.monotonically_increasing_id(), F.xxhash64(*df.columns)))
    blocks = whole.mapInArrow(_blocks, T.StructType([T.StructField("block", T.ArrayType(whole.schema))]))
    met = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(packed, "group")
    votes = [T.StructField(c, T.DoubleType()) for c in ("_zeros", "_ones")]
    kept = [f for f in whole.schema if f.name != "_x"]
    voted = met.select("block", "trees").mapInArrow(_votes, T.StructType([*kept, *votes]))
    if groups > 1:
        rest = [F.first(F.struct(*df.columns)).alias("_df")]
        voted = voted.groupBy("_row").agg(F.sum("_zeros").alias("_zeros"), F.sum("_ones").alias("_ones"), *rest)
        voted = voted.select("_df.*", "_zeros", "_ones")
    score = F.col("_ones") / (F.col("_zeros") + F.col("_ones"))
    return voted.withColumn("score", score).drop("_zeros", "_ones").withColumn("prediction", flag(F.col("score"), threshold))


def is_plain_forest(scorer) -> bool:
    """Whether a scorer is a pipeline as :func:`forest_pipeline` fits it, with two classes."""
    stages = scorer.stages if isinstance(scorer, PipelineModel) else []
    return (
        len(stages) == 2
        and isinstance(stages[0], VectorAssembler)
        and stages[0].getHandleInvalid() == "skip"
        and isinstance(stages[1], RandomForestClassificationModel)
        and (stages[1].getFeaturesCol(), stages[1].getProbabilityCol()) == (stages[0].getOutputCol(), "probability")
        and (stages[1].numFeatures, stages[1].numClasses) == (len(stages[0].getInputCols()), 2)
        and stages[1].totalNumNodes <= NODES_BROADCAST
    )


def walking_trees(nodes: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    """Arrays by node number for each tree, in order. A leaf is its own child, so that all rows take as many steps."""
    trees = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        at = np.arange(len(tree))
        leaf = tree["left"].to_numpy() < 0
        # children side by side, the left one first
        child = np.where(leaf[:, None], at[:, None], tree[["left", "right"]].to_numpy()).astype(np.int64)
        parents, depth = np.zeros(1, dtype=np.int64), 0
        while not leaf[parents].all():
            parents, depth = child[parents[~leaf[parents]]].ravel(), depth + 1
        trees.append(
            {
                "feature": np.where(leaf, 0, tree["feature"].to_numpy()).astype(np.int64),
                "threshold": tree["threshold"].to_numpy(),
                "child": child.ravel(),
                "zeros": tree["zeros"].to_numpy(),
                "ones": tree["ones"].to_numpy(),
                "depth": np.int64(depth),
            }
        )
    return trees


def walked_rows(trees: Broadcast):
    """Adds the score to rows whose features are all there; votes are added in the order of the trees."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            # all values of a feature, then of the next
            flat = batch.column("_x").flatten().to_numpy().reshape(rows, -1).T.ravel() if rows else np.zeros(0)
            place, zeros, ones = np.arange(rows), np.zeros(rows), np.zeros(rows)
            for tree in trees.value if rows else []:
                node, start = np.zeros(rows, dtype=np.int64), tree["feature"] * rows
                for _ in range(tree["depth"]):
                    value = flat.take(start.take(node) + place)
                    node = tree["child"].take(2 * node + (value > tree["threshold"].take(node)))
                zeros += tree["zeros"].take(node)
                ones += tree["ones"].take(node)
            total = zeros + ones
            score = pa.array(np.divide(ones, total, out=np.zeros(rows), where=total > 0))
            kept = [c for c in batch.schema.names if c != "_x"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], score], [*kept, "_score"])

    return walk


def score_forest_rows(df: DataFrame, model: PipelineModel) -> DataFrame:
    """:func:`apply_scorer` for many rows of a plain forest, with the same scores.

    MLlib takes one row at a time from node to node, some 1000 steps over the heap for
    a default forest. Here the nodes are read from the stored model and sent to
    all tasks as arrays.
    """
    spark, features = df.sparkSession, feature_columns(model)
    path = save_model(model, scratch_path(spark, "nodes"))
    if not spark.read.parquet(f"{path}/stages/1_*/data").filter("nodeData.split.numCategories > 0").isEmpty():
        return apply_scorer(df, model)
    trees = spark.sparkContext.broadcast(walking_trees(forest_nodes(spark, path).toPandas()))
    # rows with gaps are skipped, as by the pipeline; of filled columns nothing is left to check
    whole, kinds = df, dict(df.dtypes)
    for c in features:
        whole = whole.filter(F.col(c).isNotNull())
        whole = whole.filter(~F.isnan(c)) if kinds[c] in ("float", "double") else whole
    walked = whole.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features])).mapInArrow(
        walked_rows(trees), T.StructType([*whole.schema, T.StructField("_score", T.DoubleType())])
    )
    return apply_scorer(walked, F.col("_score")).select(*df.columns, "prediction", "score")
