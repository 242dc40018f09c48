"""Leaf-wise gradient boosting on histograms, for binary targets with row weights.

Features are cut into bins once, and rows are kept as one byte per feature beside target, weight and the
margin of the trees so far. A level of a tree is one pass: tasks add up gradient and curvature by (node,
feature, bin), one groupBy brings the sums together, and running sums over a feature's bins give each
split's gain with the regularisation of Chen and Guestrin (2016). All levels' best splits are known
before a tree is pruned to its leaves, so taking the split of highest gain first, wherever in the tree it is,
gives what growing leaf by leaf gives; ``growth="level"`` takes them level by level instead.

What reaches the driver is one row for each node. Missing values go left in every split. Sums of
floating point numbers differ in the last digits by the order in which tasks end; gains are rounded before
they are compared, and equal ones go to the first feature and bin.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship, written

#: Trees after which rows are written again with the margin so far.
KEEP = 10


@dataclass
class Tree:
    """Nodes by number: the root is 1, a node's children are 2n and 2n + 1. A split is (feature, bin): rows up to the bin go left."""

    splits: dict[int, tuple[int, int]]
    leaves: dict[int, float]

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        todo = [1]
        while todo:
            n = todo.pop()
            if n in self.splits:
                f, b = self.splits[n]
                here = np.flatnonzero(at == n)
                at[here] = 2 * n + (bins[here, f] > b)
                todo += [2 * n, 2 * n + 1]
        return at

    def value(self, bins: np.ndarray) -> np.ndarray:
        at = self.node_of(bins)
        known = np.array(sorted(self.leaves))
        return np.array([self.leaves[n] for n in known.tolist()])[np.searchsorted(known, at)]


@dataclass
class Booster:
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin 0 holds what is missing; bin k what lies above k - 1 edges."""
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left") + 1)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return sum((t.value(bins) for t in self.trees), np.full(len(x), self.base))

    def score(self, df: DataFrame, out: str = "p_red") -> DataFrame:
        """df with the probability of the target."""
        ship(df.sparkSession)
        model = self

        @F.pandas_udf(T.DoubleType())
        def p(rows: pd.Series) -> pd.Series:
            x = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), len(model.features))
            return pd.Series(1 / (1 + np.exp(-model.margin(x))))

        return df.withColumn(out, p(F.array(*[F.col(c).cast("double") for c in self.features])))


def cut_points(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins - 2`` edges of each feature at even shares of its rows, by one aggregation."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), shares, 10_000).alias(f"e{j}") for j, c in enumerate(features)]).first()
    return [sorted(set(e or [])) for e in row]


def _to_bins(model: Booster):
    def run(batches):
        for b in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], float).reshape(b.num_rows, len(model.features))
            bins = model.binned(x)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column("y"), b.column("w"), pa.array(model.margin(x) if b.num_rows else np.zeros(0)), b.column("held")], ("bins", "y", "w", "m", "held"))

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _margins(trees: list[Tree], width: int):
    def run(batches):
        for b in batches:
            bins = _matrix(b.column("bins"), width)
            m = sum((t.value(bins) for t in trees), b.column("m").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), b.column("w"), pa.array(m), b.column("held")], ("bins", "y", "w", "m", "held"))

    return run


ROWS = "bins binary, y double, w double, m double, held boolean"


def _histograms(trees: list[Tree], now: Tree, level: int, width: int, depth_bins: int):
    """Sums of gradient, curvature and rows by (node, feature, bin) of one level; and of loss, as feature -1."""

    def run(batches):
        nodes = 1 << level
        sums = np.zeros((3, nodes, width, depth_bins))
        loss = np.zeros((2, 2))
        for b in batches:
            bins = _matrix(b.column("bins"), width)
            y, w, held = b.column("y").to_numpy(), b.column("w").to_numpy(), b.column("held").to_numpy(zero_copy_only=False)
            p = 1 / (1 + np.exp(-sum((t.value(bins) for t in trees), b.column("m").to_numpy())))
            cost = -w * np.where(y > 0.5, np.log(np.maximum(p, 1e-15)), np.log(np.maximum(1 - p, 1e-15)))
            for k in (0, 1):
                loss[k] += (cost[held == k].sum(), w[held == k].sum())
            at = now.node_of(bins) - nodes
            use = np.flatnonzero(~held & (at >= 0))
            for j in range(width):
                cell = at[use] * depth_bins + bins[use, j]
                for k, v in enumerate((w[use] * (p[use] - y[use]), w[use] * p[use] * (1 - p[use]), np.ones(len(use)))):
                    sums[k, :, j] += np.bincount(cell, v, nodes * depth_bins).reshape(nodes, depth_bins)
        n, f, k = np.nonzero(sums[2])
        s = sums[:, n, f, k]
        cols = [np.concatenate([n + nodes, [0, 1]]), np.concatenate([f, [-1, -1]]), np.concatenate([k, [0, 0]]), np.concatenate([s[0], loss[:, 0]]), np.concatenate([s[1], loss[:, 1]]), np.concatenate([s[2], [0, 0]])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if i < 3 else float)) for i, c in enumerate(cols)], ("node", "feature", "bin", "g", "h", "n"))

    return run


def best_splits(sums: DataFrame, l2: float, least_h: float) -> DataFrame:
    """(node, feature, bin, gain, g, h, gl, hl) of the best split of each node from sums(node, feature, bin, g, h)."""
    by = Window.partitionBy("node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = sums.select("node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(by).alias("g"), F.sum("h").over(by).alias("h"))
    part = lambda g, h: g * g / (h + l2)
    gl, hl, g, h = F.col("gl"), F.col("hl"), F.col("g"), F.col("h")
    ok = (hl >= least_h) & (h - hl >= least_h)
    s = s.withColumn("gain", F.when(ok, F.round(part(gl, hl) + part(g - gl, h - hl) - part(g, h), 9)))
    return s.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain", "g", "h", "gl", "hl"), F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("feature"), -F.col("bin"))).alias("s")).select("node", "s.*")


def grown(found: dict[int, dict], leaves: int, l2: float, rate: float, growth: str, least_gain: float) -> Tree:
    """The tree of at most so many leaves from each node's best split: highest gains first, or level by level."""
    value = lambda g, h: -rate * g / (h + l2)
    root = found[1]
    out = {1: value(root["g"], root["h"])}
    splits: dict[int, tuple[int, int]] = {}
    rank = (lambda n: (n.bit_length(), -found[n]["gain"])) if growth == "level" else (lambda n: (-found[n]["gain"], n))
    can = lambda n: n in found and found[n]["gain"] is not None and found[n]["gain"] > least_gain
    queue = [(rank(1), 1)] if can(1) else []
    while queue and len(out) < leaves:
        n = heapq.heappop(queue)[1]
        s = found[n]
        splits[n] = (s["feature"], s["bin"])
        del out[n]
        out[2 * n], out[2 * n + 1] = value(s["gl"], s["hl"]), value(s["g"] - s["gl"], s["h"] - s["hl"])
        for k in (2 * n, 2 * n + 1):
            if can(k):
                heapq.heappush(queue, (rank(k), k))
    return Tree(splits, out)


def fit(
    df: DataFrame, features: list[str], target: str = "target", weight: str | None = None, rounds: int = 50, leaves: int = 31, depth: int = 6, rate: float = 0.1, l2: float = 1.0,
    least_h: float = 1.0, least_gain: float = 0.0, bins: int = 64, edges: list[list[float]] | None = None, growth: str = "leaf", held: DataFrame | None = None, patience: int | None = None,
) -> Booster:
    """Rows without a target are left out. ``held`` rows are only scored; with ``patience``, training ends after so many
    rounds in which their loss has not fallen, and keeps the trees up to the best."""
    spark = df.sparkSession
    ship(spark)

    def rows(d: DataFrame, is_held: bool) -> DataFrame:
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight in d.columns else F.lit(1.0)
        return d.where(F.col(target).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"), w.alias("w"), F.lit(is_held).alias("held"))

    edges = edges or cut_points(df, features, bins)
    every = rows(df, False)
    mean = every.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0]
    mean = min(max(0.5 if mean is None else mean, 1e-6), 1 - 1e-6)
    model = Booster(features, edges, math.log(mean / (1 - mean)))
    if held is not None:
        every = every.unionByName(rows(held, True))
    data, waiting, width, most = written(every.mapInArrow(_to_bins(model), ROWS), "bins"), [], len(features), max((len(e) for e in edges), default=0) + 2
    best, best_at = math.inf, 0
    for r in range(rounds + 1):
        found: dict[int, dict] = {}
        now = Tree({}, {1: 0.0})
        for level in range(depth):
            sums = data.mapInArrow(_histograms(waiting, now, level, width, most), "node long, feature long, bin long, g double, h double, n double").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            if level == 0:
                sums = sums.persist()
                loss = {x.node: (x.g, x.h) for x in sums.where("feature < 0").collect()}
            here = {x.node: x.asDict() for x in best_splits(sums.where("feature >= 0"), l2, least_h).collect()} if r < rounds else {}
            if level == 0:
                sums.unpersist()
            found |= here
            new = {n: (s["feature"], s["bin"]) for n, s in here.items() if s["gain"] is not None and s["gain"] > least_gain}
            if not new:
                break
            now = Tree(now.splits | new, {})
        mean_of = lambda k: loss[k][0] / loss[k][1] if k in loss and loss[k][1] else None
        if r:
            model.losses.append((mean_of(0), mean_of(1)))
            if mean_of(1) is not None and mean_of(1) < best:
                best, best_at = mean_of(1), r
            elif patience and mean_of(1) is not None and r - best_at >= patience:
                model.trees = model.trees[:best_at]
                break
        if r == rounds or 1 not in found:
            break
        tree = grown(found, leaves, l2, rate, growth, least_gain)
        model.trees.append(tree)
        waiting = [*waiting, tree]
        if len(waiting) == KEEP:
            data, waiting = written(data.mapInArrow(_margins(waiting, width), ROWS), "bins"), []
    return model


def splits_of(spark, model: Booster, tree: int = 0) -> DataFrame:
    """(node, feature, bin, value): a tree as a table; leaves have only a value."""
    t = model.trees[tree]
    rows = [(n, model.features[f], b, None) for n, (f, b) in t.splits.items()] + [(n, None, None, float(v)) for n, v in t.leaves.items()]
    return spark.createDataFrame(rows, "node long, feature string, bin long, value double")
