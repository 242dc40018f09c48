"""A residual perceptron for binary targets: dropout, decoupled weight decay, cosine rate, early stop, row weights.

Rows are standardised once and kept as vectors. A step takes one of the batches into which a hash of the
row deals the table; tasks compute the gradient of their rows, the sums by parameter come together in one
groupBy, and the driver, which holds one vector of parameters and its two moments, takes the step (AdamW,
Loshchilov and Hutter, 2019). So a step is that of the whole batch wherever its rows lie, up to the order
of additions. Which units are dropped is a hash of row, step and unit, not a stream of random numbers:
tasks that are run again drop the same.

Missing and non-finite values count as the mean.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import scrub
from ..session import ship, written


def shapes(inputs: int, width: int, blocks: int) -> list[tuple[int, ...]]:
    """An input layer, blocks of two layers each, which are added to what goes into them, and an output unit."""
    return [(inputs, width), (width,), *[s for _ in range(blocks) for s in ((width, width), (width,), (width, width), (width,))], (width, 1), (1,)]


def unpacked(flat: np.ndarray, sizes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for s in sizes:
        n = math.prod(s)
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def starting(sizes: list[tuple[int, ...]], seed: int) -> np.ndarray:
    """Normal weights scaled by their inputs; the second layer of a block starts small, so that blocks start near the identity."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, math.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
    for i in range(4, len(parts) - 2, 4):
        parts[i] = parts[i] * 0.1
    return np.concatenate([p.ravel() for p in parts])


def kept(rows: np.ndarray, step: int, layer: int, width: int, drop: float) -> np.ndarray:
    """1 / (1 - drop) for units that stay and 0 for others, by a hash of row, step, layer and unit."""
    x = rows.astype(np.uint64)[:, None] + np.uint64((step * 1_000_003 + layer * 7919) * 0x9E3779B97F4A7C15 % (1 << 64)) + np.arange(width, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return (u >= np.uint64(int(drop * (1 << 53)))) / (1 - drop)


def forward(params: list[np.ndarray], x: np.ndarray, rows: np.ndarray | None = None, step: int = 0, drop: float = 0.0):
    """Logits, and what the gradient needs; units are dropped only where rows are given."""
    width, trace = params[0].shape[1], []
    pre = x @ params[0] + params[1]
    h = np.maximum(pre, 0)
    trace.append((x, pre))
    for k, at in enumerate(range(2, len(params) - 2, 4)):
        w1, b1, w2, b2 = params[at : at + 4]
        pre = h @ w1 + b1
        mask = kept(rows, step, k, width, drop) if rows is not None and drop > 0 else 1.0
        a = np.maximum(pre, 0) * mask
        trace.append((h, pre, mask, a))
        h = h + a @ w2 + b2
    trace.append((h,))
    return (h @ params[-2] + params[-1])[:, 0], trace


def gradient(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray | None = None, step: int = 0, drop: float = 0.0) -> tuple[float, list[np.ndarray]]:
    """Weighted sum of the cross entropies, and its gradient."""
    z, trace = forward(params, x, rows, step, drop)
    loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
    g = (w * (1 / (1 + np.exp(-z)) - y))[:, None]
    out: list[np.ndarray] = [np.zeros(0)] * len(params)
    out[-2], out[-1] = trace[-1][0].T @ g, g.sum(0)
    gh = g @ params[-2].T
    for k in range(len(trace) - 2, 0, -1):
        at = 2 + 4 * (k - 1)
        h, pre, mask, a = trace[k]
        out[at + 2], out[at + 3] = a.T @ gh, gh.sum(0)
        ga = (gh @ params[at + 2].T) * mask * (pre > 0)
        out[at], out[at + 1] = h.T @ ga, ga.sum(0)
        gh = gh + ga @ params[at].T
    x0, pre = trace[0]
    gh = gh * (pre > 0)
    out[0], out[1] = x0.T @ gh, gh.sum(0)
    return loss, out


@dataclass
class Perceptron:
    features: list[str]
    mean: list[float]
    scale: list[float]
    width: int
    blocks: int
    flat: np.ndarray
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def vector(self) -> F.Column:
        return F.array(*[scrub((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m)) - m) / s) for c, m, s in zip(self.features, self.mean, self.scale, strict=True)])

    def sizes(self) -> list[tuple[int, ...]]:
        return shapes(len(self.features), self.width, self.blocks)

    def score(self, df: DataFrame, out: str = "p_red") -> DataFrame:
        """df with the probability of the target; nothing is dropped."""
        ship(df.sparkSession)
        flat, sizes = self.flat, self.sizes()

        @F.pandas_udf(T.DoubleType())
        def p(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, sizes[0][0]))
            return pd.Series(1 / (1 + np.exp(-forward(unpacked(flat, sizes), x)[0])))

        return df.withColumn(out, p(self.vector()))


def _sums(flat: np.ndarray, sizes: list[tuple[int, ...]], step: int, drop: float):
    """(place, value) of the gradient's sums, then of loss, weights; and of held rows' loss and weights."""

    def run(batches):
        params, total, tail = unpacked(flat, sizes), np.zeros(len(flat)), np.zeros(4)
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, sizes[0][0])
            y, w, key, held = b.column("y").to_numpy(), b.column("w").to_numpy(), b.column("key").to_numpy(), b.column("held").to_numpy(zero_copy_only=False)
            t = ~held
            if t.any():
                loss, g = gradient(params, x[t], y[t], w[t], key[t], step, drop)
                total += np.concatenate([p.ravel() for p in g])
                tail[:2] += loss, w[t].sum()
            if held.any():
                z = forward(params, x[held])[0]
                tail[2:] += (w[held] * (np.logaddexp(0, z) - y[held] * z)).sum(), w[held].sum()
        every = np.concatenate([total, tail])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every), dtype=np.int32)), pa.array(every)], ("place", "value"))

    return run


def added(rows: DataFrame, flat: np.ndarray, sizes: list[tuple[int, ...]], step: int = 0, drop: float = 0.0) -> np.ndarray:
    """The table's sums: gradient, loss, weight, held loss, held weight."""
    found = rows.mapInArrow(_sums(flat, sizes, step, drop), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(flat) + 4)
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out


def prepared(df: DataFrame, model: Perceptron, target: str, weight: str | None, held: DataFrame | None, batches: int) -> DataFrame:
    """Written rows (x, y, w, key, batch, held); rows without a target are left out."""

    def rows(d: DataFrame, is_held: bool) -> DataFrame:
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight in d.columns else F.lit(1.0)
        key = F.xxhash64(*[F.col(c).cast("double") for c in model.features])
        out = d.where(F.col(target).isNotNull()).select(model.vector().alias("x"), F.col(target).cast("double").alias("y"), w.alias("w"), key.alias("key"), F.lit(is_held).alias("held"))
        return out.withColumn("batch", F.pmod(F.shiftright("key", 7), F.lit(batches)).cast("int") if not is_held else F.lit(-1))

    both = rows(df, False)
    return written(both.unionByName(rows(held, True)) if held is not None else both, "rows")


def fit(
    df: DataFrame, features: list[str], target: str = "target", weight: str | None = None, held: DataFrame | None = None, width: int = 64, blocks: int = 2, drop: float = 0.3, epochs: int = 60,
    batches: int = 4, rate: float = 1e-2, decay: float = 1e-3, patience: int | None = 10, seed: int = 42,
) -> Perceptron:
    """With ``held`` rows the parameters of the epoch with their least loss are kept, and training ends after ``patience`` epochs without a lower one."""
    ship(df.sparkSession)
    stats = df.where(F.col(target).isNotNull()).agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"{n}{j}") for j, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    clean = lambda v, other: other if v is None or not math.isfinite(v) or v == 0 else float(v)
    model = Perceptron(features, [clean(stats[f"m{j}"], 0.0) for j in range(len(features))], [clean(stats[f"s{j}"], 1.0) for j in range(len(features))], width, blocks, np.zeros(0))
    sizes = model.sizes()
    flat = starting(sizes, seed)
    weights = np.concatenate([np.full(math.prod(s), float(len(s) == 2)) for s in sizes])
    rows = prepared(df, model, target, weight, held, batches)
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
    best, best_flat, since = math.inf, flat, 0
    for epoch in range(epochs):
        sums = np.zeros(2)
        for b in range(batches):
            # The last step of an epoch also scores the held rows, with the parameters it starts from.
            here = rows.where((F.col("batch") == b) | F.col("held")) if b == batches - 1 else rows.where(F.col("batch") == b)
            got = added(here, flat, sizes, t, drop)
            g, (loss, n, held_loss, held_n) = got[:-4], got[-4:]
            sums += loss, n
            if b == batches - 1 and held_n and held_loss / held_n < best:
                best, best_flat, since = held_loss / held_n, flat, 0
            elif b == batches - 1:
                since += 1
            if not n:
                continue
            t += 1
            at = rate * 0.5 * (1 + math.cos(math.pi * (epoch * batches + b) / (epochs * batches)))
            g = g / n
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - at * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * weights * flat)
        model.losses.append((float(sums[0] / sums[1]) if sums[1] else math.nan, float(held_loss / held_n) if held_n else None))
        if held is not None and patience and since >= patience:
            break
    model.flat = best_flat if math.isfinite(best) else flat
    return model
