"""Gradient-boosted trees for several classes, each against all others, grown together.

The rule is that of Spark ML's GBTClassifier with its defaults (log loss, variance, 32 bins, one row at
least per node, candidate thresholds from about 10,000 rows), so on tables of at most 10,000 rows its
models are the same but for rounding.  Spark ML fits one class at a time and goes over the rows for each
class, round and level; here one pass serves the same level of all classes.

Rows are binned once and kept in blocks with a byte per feature, dealt evenly.  A pass adds up gradients
by class, node, feature and bin in each task; one shuffle by class adds these sums and picks each node's
split, so the driver gets a split per node.  Sums of a class have a fixed size, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, BLOCK_ROWS, SAMPLED = 32, 32_768, 10_000


@dataclass
class Boosted:
    """Classes in alphabetical order, ascending thresholds of each feature, and per round (class, node) arrays of a full tree.

    Nodes are numbered by level; a row goes left where its bin is at most ``at`` of the node's ``feature``.
    """

    names: list[str]
    features: tuple[str, ...]
    thresholds: list[np.ndarray]
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, at, value of each leaf
    weights: list[float] = field(default_factory=list)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """(feature, row): how many thresholds are below the value; a missing one is above all."""
        return np.stack([np.searchsorted(t, x, "left").astype(np.uint8) for t, x in zip(self.thresholds, columns, strict=True)])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """(class, row): weighted sum of all trees."""
        out = np.zeros((len(self.names), bins.shape[1]))
        for (feature, at, value), weight in zip(self.trees, self.weights, strict=True):
            for k in range(len(self.names)):
                out[k] += weight * value[k][reached(bins, feature[k], at[k], self.depth)]
        return out


def reached(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The node of a level that each row reaches, numbered from the level's first."""
    rows = np.arange(bins.shape[1])
    node = np.zeros(bins.shape[1], np.int64)
    for level in range(depth):
        own = node + ((1 << level) - 1)
        node = 2 * node + (bins[feature[own], rows] > at[own])
    return node


def thresholds(values: np.ndarray, splits: int = BINS - 1) -> np.ndarray:
    """Borders between a sample's distinct values: all, or about ``splits`` with equal numbers of rows between them."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) - 1 <= splits:
        return (distinct[:-1] + distinct[1:]) / 2
    stride = len(values) / (splits + 1)
    out, target, seen = [], stride, int(counts[0])
    for i in range(1, len(distinct)):
        before, seen = seen, seen + int(counts[i])
        # The border that is nearer to the target.
        if abs(before - target) < abs(seen - target):
            out.append((distinct[i - 1] + distinct[i]) / 2)
            target += stride
    return np.array(out)


def _sampled(df: DataFrame, features: tuple[str, ...]) -> np.ndarray:
    """About 10,000 rows by a hash of the row, or all of a smaller table: (row, feature)."""
    n = df.count()
    share = min(1.0, SAMPLED / n) if n else 1.0
    if share < 1:
        key = ("event_id",) if "event_id" in df.columns else features
        df = df.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(share * (1 << 40)))
    return np.array([tuple(r) for r in df.select(*(F.col(f).cast("double") for f in features)).collect()], float).reshape(-1, len(features))


BLOCK = "block long, label binary, bins binary, margin binary"


def _blocks(df: DataFrame, model: Boosted, cores: int) -> DataFrame:
    """Rows by blocks: class numbers, bins and margins, dealt by the block's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            label, bins = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], 1)
            margin = np.zeros((len(model.names), len(label)))
            values = [pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (label, bins, margin))]
            return pa.RecordBatch.from_arrays(values, ["block", "label", "bins", "margin"])

        for b in batches:
            label, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            held.append((label.astype(np.uint8), model.bins(columns)))
            rows += len(label)
            if rows >= BLOCK_ROWS:
                yield block()
                number, held, rows = number + 1, [], 0
        if rows:
            yield block()

    names = F.array(*map(F.lit, model.names))
    label = (F.array_position(names, F.col("fire_type")) - 1).cast("int").alias("label")
    rows = df.select(label, *(F.col(f).cast("double").alias(f) for f in model.features))
    return rows.mapInArrow(run, BLOCK).repartition(cores, "block").sortWithinPartitions("block")


def _opened(b: pa.RecordBatch, model: Boosted) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, labels (row), bins (feature, row) and margins (class, row) of each block."""
    for number, label, bins, margin in zip(*b.columns, strict=True):
        label = np.frombuffer(label.as_buffer(), np.uint8)
        yield (
            number.as_py(), label, np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(label)),
            np.frombuffer(margin.as_buffer()).reshape(len(model.names), len(label)),
        )


def _advanced(blocks: DataFrame, model: Boosted) -> DataFrame:
    """Blocks with the last tree of each class added to the margins."""
    (feature, at, value), weight, depth = model.trees[-1], model.weights[-1], model.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, label, bins, margin in _opened(b, model):
                new = np.stack([m + weight * value[k][reached(bins, feature[k], at[k], depth)] for k, m in enumerate(margin)])
                values = [pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (label, bins, new))]
                yield pa.RecordBatch.from_arrays(values, ["block", "label", "bins", "margin"])

    return blocks.mapInArrow(run, BLOCK)


def best_splits(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node: feature and bin of the split that lowers the variance most, and the means on its left and right.

    count and total are by (node, feature, bin).  A node that no split betters sends all rows to its left.
    """
    nodes, features, _ = count.shape
    n, s = count[:, :1].sum(2, keepdims=True), total[:, :1].sum(2, keepdims=True)
    left_n, left_s = count.cumsum(2), total.cumsum(2)
    right_n, right_s = n - left_n, s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - s**2 / n
        gain = np.where((left_n > 0) & (right_n > 0), gain, -np.inf).reshape(nodes, -1)
        best, every = gain.argmax(1), np.arange(nodes)
        feature, at = best // BINS, best % BINS
        left, right = (part_s[every, feature, at] / part_n[every, feature, at] for part_s, part_n in ((left_s, left_n), (right_s, right_n)))
        mean = np.where(n > 0, s / n, 0.0).ravel()
    split = gain[every, best] > 0
    return np.where(split, feature, 0), np.where(split, at, BINS), np.where(split, left, mean), np.where(split, right, mean)


SPLITS = "k int, feature array<int>, at array<int>, left array<double>, right array<double>"


def _level(blocks: DataFrame, model: Boosted, feature: np.ndarray, at: np.ndarray, level: int, first: bool) -> list:
    """The splits of one level of the present tree of every class, one row per class."""
    classes, nodes, n_features = len(model.names), 1 << level, len(model.features)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, 2, n_features, nodes * BINS))
        for b in batches:
            for _, label, bins, margin in _opened(b, model):
                for k in range(classes):
                    y = np.where(label == k, 1.0, -1.0)
                    # The first tree learns the labels, the others what the log loss leaves.
                    with np.errstate(over="ignore"):
                        g = y if first else 4 * y / (1 + np.exp(2 * y * margin[k]))
                    node = reached(bins, feature[k], at[k], level) * BINS
                    for f in range(n_features):
                        cell = node + bins[f]
                        sums[k, 0, f] += np.bincount(cell, minlength=nodes * BINS)
                        sums[k, 1, f] += np.bincount(cell, g, minlength=nodes * BINS)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(classes), pa.int32()), pa.array([part] * classes, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())],
            ["k", "part", "sums"],
        )

    def chosen(t: pa.Table) -> pa.Table:
        sums = np.zeros((2, n_features, nodes, BINS))
        for s in t.sort_by("part")["sums"]:
            sums += np.frombuffer(s.as_buffer()).reshape(sums.shape)
        found = best_splits(*sums.transpose(0, 2, 1, 3))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
        columns = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in zip(found, kinds, strict=True)]
        return pa.table([t["k"][:1], *columns], names=["k", "feature", "at", "left", "right"])

    return sorted(blocks.mapInArrow(summed, "k int, part int, sums binary").groupBy("k").applyInArrow(chosen, SPLITS).collect(), key=lambda r: r["k"])


def train(df: DataFrame, features: tuple[str, ...], rounds: int = 12, depth: int = 5, step: float = 0.4) -> Boosted:
    """Trees that tell each ``fire_type`` from all others; an empty table gives a model without classes."""
    names = sorted(r[0] for r in df.select("fire_type").distinct().collect())
    model = Boosted(names, tuple(features), [thresholds(x) for x in _sampled(df, features).T], depth)
    if not names:
        return model
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(df, model, cores).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for m in range(rounds):
            feature, at = (np.zeros((len(names), (1 << depth) - 1), np.int64) for _ in range(2))
            for level in range(depth):
                found = _level(blocks, model, feature, at, level, m == 0)
                own = slice((1 << level) - 1, (2 << level) - 1)
                for r in found:
                    feature[r["k"], own], at[r["k"], own] = r["feature"], r["at"]
                if m and level == 0:
                    before.unpersist()  # its successor is kept by now
            value = np.array([np.stack([r["left"], r["right"]], 1).ravel() for r in found])
            model.trees.append((feature, at, value))
            model.weights.append(step if m else 1.0)
            if m + 1 < rounds:
                before, blocks = blocks, _advanced(blocks, model).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        blocks.unpersist()
    return model


def probabilities(model: Boosted, df: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and ``_p``, the probability of each class against the others."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[len(kept) :]]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-2 * model.margins(model.bins(columns))))
            ends = pa.array(np.arange(b.num_rows + 1) * len(model.names), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(p.T.ravel()))], [*kept, "_p"])

    rows = df.select(*kept, *(F.col(f).cast("double").alias(f"_x_{f}") for f in model.features))
    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "_p array<double>"]))
