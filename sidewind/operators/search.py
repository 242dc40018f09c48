"""Adaptive search of parameters: the ratio of two Parzen estimates over past trials (Bergstra et al., 2011).

Trials run in rounds. The best quarter of the trials so far are the good ones; for each parameter a
mixture of normals around the good values is drawn from, and the draw with the highest ratio of the good
density to the others' is tried. The trials of a round are proposed one after another, each with the
round's earlier ones among the bad, which keeps them apart, and are then fitted side by side, as Spark
jobs of several threads.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from .evaluate import purged_folds

#: Rows of a fold for one task.
TASK_ROWS = 100_000

#: name -> ("float", low, high), ("log", low, high), ("int", low, high) or ("choice", values)
Space = dict[str, tuple]
Trial = tuple[dict, float]


def _to_line(kind: tuple, value) -> float:
    return math.log(value) if kind[0] == "log" else float(value)


def _from_line(kind: tuple, x: float):
    low, high = kind[1], kind[2]
    if kind[0] == "log":
        return min(max(math.exp(x), low), high)
    return min(max(round(x), low), high) if kind[0] == "int" else min(max(x, low), high)


def _bounds(kind: tuple) -> tuple[float, float]:
    low, high = _to_line(kind, kind[1]), _to_line(kind, kind[2])
    return (low - 0.5, high + 0.5) if kind[0] == "int" else (low, high)


class _Parzen:
    """Normals around points on a line, each as wide as the larger gap to its neighbours, and one as wide as the line."""

    def __init__(self, points: list[float], low: float, high: float):
        at = sorted([*points, (low + high) / 2])
        wide = (high - low) or 1.0
        edges = [low, *at, high]
        least = wide / min(100, 1 + len(at))
        self.parts = [(x, wide if i == at.index((low + high) / 2) else min(max(x - edges[i], edges[i + 2] - x, least), wide)) for i, x in enumerate(at)]
        self.low, self.high = low, high

    @staticmethod
    def _below(x: float, mean: float, sd: float) -> float:
        return 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2))))

    def draw(self, rng: random.Random) -> float:
        mean, sd = rng.choice(self.parts)
        for _ in range(100):
            x = rng.gauss(mean, sd)
            if self.low <= x <= self.high:
                return x
        return mean

    def density(self, x: float) -> float:
        out = 0.0
        for mean, sd in self.parts:
            inside = self._below(self.high, mean, sd) - self._below(self.low, mean, sd)
            out += math.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return out / len(self.parts)


def any_of(space: Space, rng: random.Random) -> dict:
    """A draw that looks at no trial."""
    return {n: rng.choice(k[1]) if k[0] == "choice" else _from_line(k, rng.uniform(*_bounds(k))) for n, k in space.items()}


def propose(space: Space, trials: list[Trial], rng: random.Random, good: float = 0.25, draws: int = 24, first: int = 8) -> dict:
    """The next parameters to try; a plain draw until there are ``first`` trials. Lower scores are better."""
    if len(trials) < first:
        return any_of(space, rng)
    ranked = sorted(trials, key=lambda t: t[1])
    cut = max(2, math.ceil(good * len(ranked)))
    best, rest = ranked[:cut], ranked[cut:]
    out = {}
    for name, kind in space.items():
        if kind[0] == "choice":
            # Of few values the one that looks best would be taken for ever, so they are drawn by their ratios.
            share = lambda of, v: (1 + sum(p[name] == v for p, _ in of)) / (len(kind[1]) + len(of))
            out[name] = rng.choices(kind[1], [share(best, v) / share(rest, v) for v in kind[1]])[0]
            continue
        low, high = _bounds(kind)
        of = lambda ts: _Parzen([_to_line(kind, p[name]) for p, _ in ts], low, high)
        near, far = of(best), of(rest)
        out[name] = _from_line(kind, max((near.draw(rng) for _ in range(draws)), key=lambda x: near.density(x) / max(far.density(x), 1e-300)))
    return out


def search(objective: Callable[[dict], float], space: Space, rounds: int, per_round: int = 4, seed: int = 42, threads: int | None = None) -> list[Trial]:
    """All trials (parameters, score) in order; a score that is not a number counts as the worst."""
    rng, trials = random.Random(seed), []
    for _ in range(rounds):
        asked: list[dict] = []
        for _ in range(per_round):
            asked.append(propose(space, [*trials, *[(p, math.inf) for p in asked]] if len(trials) >= 8 else trials, rng))
        run = inheritable_thread_target(objective) if threads != 1 else objective
        with ThreadPoolExecutor(threads or per_round) as pool:
            scores = list(pool.map(run, asked))
        trials += [(p, s if s is not None and s == s else math.inf) for p, s in zip(asked, scores, strict=True)]
    return trials


def tune(
    df: DataFrame, fit_score: Callable[[DataFrame, DataFrame, dict], float], space: Space, rounds: int, per_round: int = 4, order: str = "date", folds: int = 5, gap_days: int = 180, least: tuple[int, int] = (50, 20), seed: int = 42,
    ready: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> tuple[dict, DataFrame]:
    """The parameters with the least mean score over purged folds, and (trial, params, score) of all trials.

    fit_score(train, test, params) fits on a fold's training rows and scores its test rows. What is the same for
    all parameters is done by ready(train, test), once for each fold; fit_score gets the frames that it returns.
    """
    rows = purged_folds(df, order, folds, gap_days, least).persist()
    sizes = {(r.fold, r.role): r["count"] for r in rows.groupBy("fold", "role").count().collect()}
    found = sorted({k for k, _ in sizes})

    def parts_of(k: int) -> tuple[DataFrame, DataFrame]:
        pair = [rows.where(f"fold = {k} AND role = '{role}'").drop("fold", "role") for role in ("train", "test")]
        if not ready:
            return tuple(pair)
        # A fit is many short jobs over these rows, so a task gets no fewer than are worth its start.
        return tuple(d.coalesce(-(-sizes[k, role] // TASK_ROWS)).persist() for d, role in zip(ready(*pair), ("train", "test"), strict=True))

    def each(run: Callable[[int], object]) -> list:
        with ThreadPoolExecutor(len(found)) as pool:
            return list(pool.map(inheritable_thread_target(run), found))

    parts = dict(zip(found, each(parts_of), strict=True)) if found else {}
    objective = lambda p: sum(each(lambda k: fit_score(*parts[k], p))) / len(found)
    trials = search(objective, space, rounds, per_round, seed) if found else []
    for d in [rows, *(d for pair in parts.values() for d in pair if ready)]:
        d.unpersist()
    best = min(trials, key=lambda t: t[1])[0] if trials else {}
    texts = [", ".join(f"{n}={p[n]:.6g}" if isinstance(p[n], float) else f"{n}={p[n]}" for n in sorted(p)) for p, _ in trials]
    table = pa.table({"trial": pa.array(range(len(trials)), pa.int32()), "params": pa.array(texts, pa.string()), "score": pa.array([float(s) for _, s in trials], pa.float64())})
    return best, df.sparkSession.createDataFrame(table)
