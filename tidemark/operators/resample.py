"""Bootstrap of the class-1 metrics.

Draw ``i`` belongs to iteration ``i div n`` and picks row ``draw(i) mod n``:
``n`` draws with replacement per iteration, the same on every run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import draw
from tidemark.operators.metrics import CELLS, ratio

#: draws per task; a task keeps running counts only, so this bounds time, not memory
DRAWS_PER_TASK = 50_000_000
SCORES = ("F1", "P", "R")
#: rows of a packed block, and rows whose packed cells, a byte each, are sent to all tasks
BLOCK_ROWS, BROADCAST_ROWS = 65_536, 64_000_000


def draws(spark: SparkSession, n: int, iterations: int, seed: int) -> DataFrame:
    """(iter_id, row_id): the generated picks. Tasks hold contiguous ranges,
    so that counting per iteration collapses them before the shuffle."""
    total = n * iterations
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // DRAWS_PER_TASK))
    numbers = spark.range(0, total, 1, tasks)
    # never null, and coalesce says so: a join would otherwise filter on the
    # whole draw expression, evaluated without sharing its common parts
    picked = F.coalesce(draw(seed, F.col("id")) % F.lit(n), F.lit(0).cast("long"))
    return numbers.select(F.expr(f"id div {n}").alias("iter_id"), picked.alias("row_id"))


def packed_cells(predictions: DataFrame, rows: int) -> DataFrame:
    """(block, cells): the confusion cell of each row id of a block, one byte each, in order."""
    y, p = F.col("y_true"), F.col("y_pred")
    cell = F.lit(len(CELLS))  # a label other than 0 and 1 is in none
    for number, (truth, told) in enumerate(((1, 1), (0, 1), (0, 0), (1, 0))):
        cell = F.when((y == truth) & (p == told), number).otherwise(cell)
    at = F.struct((F.col("row_id") % rows).alias("place"), cell.cast("tinyint").alias("cell"))
    packed = predictions.select(F.expr(f"row_id div {rows}").alias("block"), at.alias("at"))
    packed = packed.groupBy("block").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return packed.select("block", F.transform("at", lambda x: x["cell"]).alias("cells"))


def bootstrap_by_rows(predictions: DataFrame, iterations: int = 100, seed: int = 42) -> DataFrame:
    """Confusion cells per iteration, by looking up the picked rows.

    ``predictions`` holds (row_id, y_true, y_pred) with row ids 0..n-1. They are
    packed into blocks of a byte per row, and a pick finds its cell by block and
    place. Up to ``BROADCAST_ROWS`` rows the blocks go to all tasks; beyond that
    picks are dealt to their block and the blocks, which are few, are hashed: the
    picks are never sorted.
    """
    spark = predictions.sparkSession
    n, last = predictions.agg(F.count("*"), F.max("row_id")).first()
    if n == 0:
        raise ValueError("nothing to resample: no predictions")
    if last != n - 1:
        raise ValueError(f"row ids are not 0 to {n - 1}")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = min(BLOCK_ROWS, max(1, -(-n // (4 * tasks))))
    packed = packed_cells(predictions, rows)
    small = n <= BROADCAST_ROWS and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    packed = F.broadcast(packed) if small else packed.hint("shuffle_hash")
    picks = draws(spark, n, iterations, seed)
    # said to be never null, as in draws(): a join would otherwise filter on the whole draw expression
    block = F.coalesce(F.expr(f"row_id div {rows}"), F.lit(0).cast("long"))
    picks = picks.select("iter_id", block.alias("block"), (F.col("row_id") % rows).cast("int").alias("place"))
    found = picks.join(packed, "block").select("iter_id", F.get("cells", F.col("place")).alias("cell"))
    return found.groupBy("iter_id").agg(*[F.count_if(F.col("cell") == i).alias(name) for i, name in enumerate(CELLS)])


def bootstrap_by_cells(spark: SparkSession, cells: Mapping[str, int], iterations: int = 100, seed: int = 42) -> DataFrame:
    """Confusion cells per iteration, from the four cell sizes alone.

    The metrics depend on a draw only through the cell it falls in. With rows
    numbered cell by cell, a pick names its cell by comparison: the same
    distribution as the row join, with no join and no row table.
    """
    sizes = [int(cells[c]) for c in CELLS]
    n = sum(sizes)
    if n == 0:
        raise ValueError("nothing to resample: all cells are empty")
    pick, bound, counts = F.col("row_id"), 0, []
    for name, size in zip(CELLS, sizes):
        counts.append(F.count_if((pick >= bound) & (pick < bound + size)).alias(name))
        bound += size
    return draws(spark, n, iterations, seed).groupBy("iter_id").agg(*counts)


def replicate_scores(counts: DataFrame) -> DataFrame:
    """(iter_id, F1, P, R) with 0 where a ratio has nothing below the line."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "iter_id",
        ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("F1"),
        ratio(tp, tp + fp).alias("P"),
        ratio(tp, tp + fn).alias("R"),
    )


def _known(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def replicate_stats(scores: DataFrame, metrics=SCORES) -> DataFrame:
    """(metric, n, mean, variance) per metric, missing replicates left out."""
    long = scores.unpivot([], list(metrics), "metric", "value").filter(_known(F.col("value")))
    return long.groupBy("metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("variance"),
    )
