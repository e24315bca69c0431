"""Many forests on the same rows, each only to be judged on a second set of rows.

A parameter search needs no models, only what they say of the validation side. MLlib grows
a forest level by level over the cluster: for each level every partition sends sums for all
nodes, and the driver holds all trees. Here the rows are put into bins once, a byte per
feature, and sent to all tasks; a task grows whole trees by itself, lets the validation rows
walk them and returns their votes. Nothing is shuffled while trees grow, and the driver
holds no tree.

The trees follow MLlib's rules: BINS values of a feature are told apart; each tree takes each
row a Poisson(1) number of times; each node looks at a random subset of the features and
takes the cut with the largest gain in weighted Gini impurity that leaves enough rows on
both sides; leaves that say the same as their sibling are merged with it. A tree on all
rows and features is the one MLlib grows, but for cuts of equal gain, which rounding decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.weights import ClassWeights
from tidemark.schema import LABEL
from tidemark.session import materialize

if TYPE_CHECKING:
    from tidemark.operators.forest import ForestParams

#: trees that one task grows, fewer if they are deep, and more if the votes of all tasks would be larger than that
TREES_PER_TASK, LEVELS_PER_TASK = 20, 120
VOTES_BYTES = 1_000_000_000
#: nodes whose sums are held at once, and validation rows whose votes are one array
NODES_AT_ONCE, ROWS_PER_BLOCK = 8192, 65_536

Tree = dict[str, np.ndarray]


def subset_size(strategy: str, trees: int, features: int) -> int:
    """Features that a node looks at, by the names MLlib has for it."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    sizes = {"all": features, "sqrt": math.sqrt(features), "log2": math.log(features) / math.log(2), "onethird": features / 3.0}
    return max(1, math.ceil(sizes[strategy]))


def _impurity(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Gini impurity; of nothing it is 0."""
    whole = zeros + ones
    return np.where(whole > 0, 1.0 - (zeros**2 + ones**2) / np.where(whole > 0, whole, 1.0) ** 2, 0.0)


def _best_cuts(hist: np.ndarray, held: np.ndarray, weights: tuple[float, float], least: int) -> tuple[np.ndarray, ...]:
    """Per node the place of the feature in its subset, the last bin on the left, the gain, and what goes left by class.

    ``hist`` counts rows by node, place, bin and class; ``held`` by node and class.
    """
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = held[:, None, None, :] - left
    enough = (left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least)
    l0, l1, r0, r1 = left[..., 0] * weights[0], left[..., 1] * weights[1], right[..., 0] * weights[0], right[..., 1] * weights[1]
    whole = (held * np.array(weights)).sum(axis=1)[:, None, None]
    parent = _impurity(held[:, 0] * weights[0], held[:, 1] * weights[1])[:, None, None]
    gain = parent - ((l0 + l1) / whole) * _impurity(l0, l1) - ((r0 + r1) / whole) * _impurity(r0, r1)
    gain = np.where(enough, gain, -np.inf).reshape(len(hist), -1)
    best, node = gain.argmax(axis=1), np.arange(len(hist))
    place, cut = np.divmod(best, left.shape[2])
    return place, cut, gain[node, best], left[node, place, cut]


def grow_tree(
    bins: np.ndarray,
    ones: np.ndarray,
    bag: np.ndarray,
    weights: tuple[float, float],
    kinds: int,
    depth: int,
    least: int,
    subset: int,
    numbers: np.random.Generator,
) -> Tree:
    """A tree as arrays by node; children lie side by side, and a leaf is its own child.

    ``bins`` has a row of bins per feature, below ``kinds``; ``bag`` says how often each row is taken.
    """
    features, size = bins.shape
    flat, rows = bins.ravel(), np.flatnonzero(bag)
    taken, label = bag[rows].astype(np.float64), ones[rows].astype(np.int64)
    held = np.bincount(label, taken, 2)[None, :]
    levels = [{"held": held}]
    active = np.zeros(1, dtype=np.int64) if held.min() > 0 else np.zeros(0, dtype=np.int64)
    place, first = np.zeros(len(rows), dtype=np.int64), 0
    for level in range(depth):
        if not len(active):
            break
        held, count = levels[-1]["held"], len(active)
        looked = np.sort(numbers.random((count, features)).argsort(axis=1)[:, :subset], axis=1)
        found = []
        order = np.argsort(place, kind="stable") if count > NODES_AT_ONCE else None
        for low in range(0, count, NODES_AT_ONCE):
            high = min(count, low + NODES_AT_ONCE)
            own = slice(None) if order is None else order[np.searchsorted(place, low, sorter=order) : np.searchsorted(place, high, sorter=order)]
            node, row, hist = place[own] - low, rows[own], np.empty((high - low, subset, kinds, 2))
            for j in range(subset):
                key = (node * kinds + flat[looked[low:high, j][node] * size + row]) * 2 + label[own]
                hist[:, j] = np.bincount(key, taken[own], (high - low) * kinds * 2).reshape(high - low, kinds, 2)
            found.append(_best_cuts(hist, held[active[low:high]], weights, least))
        at, cut, gain, left = (np.concatenate(x) for x in zip(*found))
        split = gain > 0
        parents = active[split]
        feature = looked[np.arange(count), at]
        below = np.stack([left, held[active] - left], axis=1)[split].reshape(-1, 2)
        levels[-1] |= {"split": parents, "feature": feature[split], "cut": cut[split]}
        levels.append({"held": below})
        # a pure child is a leaf, and so are all at the greatest depth
        mixed = below.min(axis=1) > 0
        active = np.flatnonzero(mixed)
        child = np.full(count, -1, dtype=np.int64)
        child[split] = 2 * np.arange(len(parents))
        goes_on = child[place] >= 0
        place, rows, taken, label = place[goes_on], rows[goes_on], taken[goes_on], label[goes_on]
        number = child[place] + (flat[feature[place] * size + rows] > cut[place])
        inner = np.cumsum(mixed) - 1
        stays = mixed[number]
        place, rows, taken, label = inner[number[stays]], rows[stays], taken[stays], label[stays]
    return _joined_levels(levels, weights)


def _joined_levels(levels: list[Tree], weights: tuple[float, float]) -> Tree:
    held = np.concatenate([x["held"] for x in levels])
    weight = held * np.array(weights)
    number = np.arange(len(held))
    feature, cut, child = np.zeros(len(held), dtype=np.int64), np.full(len(held), 255), number.copy()
    leaf, says = np.ones(len(held), dtype=bool), weight[:, 1] > weight[:, 0]
    starts = np.cumsum([0, *(len(x["held"]) for x in levels)])
    for k in range(len(levels) - 2, -1, -1):
        parents = starts[k] + levels[k]["split"]
        left = starts[k + 1] + 2 * np.arange(len(parents))
        apart = ~(leaf[left] & leaf[left + 1] & (says[left] == says[left + 1]))
        inner = parents[apart]
        leaf[inner], child[inner] = False, left[apart]
        feature[inner], cut[inner] = levels[k]["feature"][apart], levels[k]["cut"][apart]
    whole = weight.sum(axis=1)
    share = np.divide(weight, whole[:, None], out=np.zeros_like(weight), where=whole[:, None] > 0)
    return {"feature": feature, "cut": cut, "child": child, "zeros": share[:, 0], "ones": share[:, 1], "depth": np.int64(len(levels) - 1)}


def leaves(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``bins`` comes to."""
    flat, size = bins.ravel(), bins.shape[1]
    node, row = np.zeros(size, dtype=np.int64), np.arange(size)
    for _ in range(tree["depth"]):
        node = tree["child"].take(node) + (flat.take(tree["feature"].take(node) * size + row) > tree["cut"].take(node))
    return node


def binned(df: DataFrame, features: list[str], middles: dict[str, list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the rows whose features are all there, a byte each, and labels; a value up to a middle is left of it."""
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in features], LABEL).na.drop(subset=features)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.searchsorted(middles[c], batch.column(c).to_numpy()).astype(np.int8) for c in features]
            yield pa.RecordBatch.from_arrays([*map(pa.array, bins), batch.column(LABEL)], [*features, LABEL])

    schema = ", ".join(f"`{c}` byte" for c in features) + f", `{LABEL}` {dict(df.dtypes)[LABEL]}"
    # in an order that does not depend on how the rows lay
    table = whole.mapInArrow(put, schema).toArrow().sort_by([(c, "ascending") for c in (*features, LABEL)])
    bins = np.stack([table.column(c).to_numpy().astype(np.uint8) for c in features])
    return bins, table.column(LABEL).to_numpy()


def tree_tasks(picks: list[ForestParams], rows: int) -> list[tuple[int, int, int]]:
    """(trial, first tree, last tree + 1), the longest tasks first. ``rows`` are voted on."""
    most = VOTES_BYTES // (16 * max(1, rows))
    tasks, least = [], -(-sum(p.numTrees for p in picks) // max(1, most))
    for trial, p in enumerate(picks):
        size = max(1, least, min(TREES_PER_TASK, LEVELS_PER_TASK // max(1, p.maxDepth)))
        tasks += [(trial, low, min(p.numTrees, low + size)) for low in range(0, p.numTrees, size)]
    return sorted(tasks, key=lambda t: (-(t[2] - t[1]) * picks[t[0]].maxDepth, t))


def grow_and_walk(rows: Broadcast, picks: list[ForestParams], tasks: list[tuple[int, int, int]], weights: tuple[float, float], kinds: int) -> Callable:
    """For each task the votes of its trees on the validation rows, by blocks of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                trial, low, high = tasks[task]
                p, (train, labels, valid, _) = picks[trial], rows.value
                zeros, ones = np.zeros(valid.shape[1]), np.zeros(valid.shape[1])
                for tree in range(low, high):
                    numbers = np.random.default_rng([p.seed % 2**32, trial, tree])
                    bag = numbers.poisson(1.0, train.shape[1])
                    subset = subset_size(p.featureSubsetStrategy, p.numTrees, len(train))
                    grown = grow_tree(train, labels, bag, weights, kinds, p.maxDepth, p.minInstancesPerNode, subset, numbers)
                    leaf = leaves(grown, valid)
                    zeros += grown["zeros"][leaf]
                    ones += grown["ones"][leaf]
                for block in range(-(-len(ones) // ROWS_PER_BLOCK)):
                    own = slice(block * ROWS_PER_BLOCK, (block + 1) * ROWS_PER_BLOCK)
                    values = [[trial], [low], [block], [zeros[own]], [ones[own]]]
                    names = ["trial", "low", "block", "zeros", "ones"]
                    kinds_of = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds_of)], names)

    return work


def _added_votes(rows: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The scores of a block of rows, from the votes of all tasks of a trial in the order of the trees."""

    def add(votes: pd.DataFrame) -> pd.DataFrame:
        votes = votes.sort_values("low")
        zeros, ones = (sum(np.asarray(x) for x in votes[c]) for c in ("zeros", "ones"))
        low = int(votes["block"].iloc[0]) * ROWS_PER_BLOCK
        total = zeros + ones
        score = np.divide(ones, total, out=np.zeros(len(ones)), where=total > 0)
        # the class with more votes, the first one at a tie
        return pd.DataFrame({"trial": votes["trial"].iloc[0], LABEL: rows.value[3][low : low + len(ones)], "score": score, "prediction": (ones > zeros).astype("int32")})

    return add


def score_trials(
    train: DataFrame,
    valid: DataFrame,
    features: Iterable[str],
    picks: list[ForestParams],
    weights: ClassWeights,
    values: dict[str, list[float]],
) -> DataFrame | None:
    """(trial, label, score, prediction): each validation row as the forest of each trial scores it.

    None if ``train`` has no whole row or labels other than 0 and 1. ``values`` are those that are told apart of each feature.
    """
    spark, features = train.sparkSession, list(features)
    middles = {c: [(low + high) / 2.0 for low, high in zip(values[c], values[c][1:])] for c in features}
    bins, labels = binned(train, features, middles)
    if not len(labels) or not np.isin(labels, (0, 1)).all():
        return None
    kinds = max(2, *(len(v) for v in values.values()))
    walked, known = binned(valid, features, middles)
    rows = spark.sparkContext.broadcast((bins, labels.astype(np.uint8), walked, known))
    tasks = tree_tasks(picks, len(known))
    grow = grow_and_walk(rows, picks, tasks, (weights.weight_0, weights.weight_1), kinds)
    votes = materialize(
        spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(grow, "trial int, low int, block int, zeros array<double>, ones array<double>"), "votes"
    )
    schema = f"trial int, `{LABEL}` {dict(valid.dtypes)[LABEL]}, score double, prediction int"
    return materialize(votes.groupBy("trial", "block").applyInPandas(_added_votes(rows), schema), "scores")
