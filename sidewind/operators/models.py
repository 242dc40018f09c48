"""Models over feature matrices: estimators, calibration, votes, stacking, importance, drift.

The kinds are MLlib's logistic regression (lr), forest (rf), level-wise boosting (gbt) and perceptron (mlp),
and the engine's own leaf-wise boosting (leaf, ``boosting``) and residual perceptron (net, ``perceptron``).
MLlib's scaler divides by the sample deviation. Metrics are reported as measured.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finish_class
from ..session import written
from . import boosting, perceptron
from .aggregates import auc
from .donors import with_donors
from .evaluate import purged_folds
from .scans import positions

KINDS = ("lr", "rf", "gbt", "leaf", "net")


def diffs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_diff")]


def balanced(df: DataFrame, target: str = "target", weight: str | None = None) -> DataFrame:
    """Adds row_weight: inverse class share, times the row's own weight. One small aggregation."""
    shares = df.groupBy(target).agg(F.count("*").alias("_n"))
    total = shares.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    own = F.col(weight) if weight else F.lit(1.0)
    return df.join(F.broadcast(shares), target).crossJoin(F.broadcast(total)).withColumn("row_weight", own * F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def scaler(features: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_vector", handleInvalid="keep"), StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True)])


def learner(kind: str, width: int, target: str = "target", seed: int = 42, classes: int = 2, **params):
    """MLlib's estimator of a kind over vectors of so many scaled features."""
    common = {"featuresCol": "_scaled", "labelCol": target}
    weighted = {"weightCol": "row_weight"}
    return {
        "lr": lambda: LogisticRegression(**common, **weighted, **{"regParam": 0.01, "maxIter": 50} | params),
        "rf": lambda: RandomForestClassifier(**common, **weighted, seed=seed, **{"numTrees": 40, "maxDepth": 6} | params),
        "gbt": lambda: GBTClassifier(**common, **weighted, seed=seed, **{"maxIter": 20, "maxDepth": 3, "stepSize": 0.1} | params),
        "mlp": lambda: MultilayerPerceptronClassifier(**common, seed=seed, **{"layers": [width, 16, classes], "maxIter": 50} | params),
    }[kind]()


def estimator(kind: str, features: list[str], target: str = "target", **params) -> Pipeline:
    return Pipeline(stages=[*scaler(features).getStages(), learner(kind, len(features), target, **params)])


def readied(train: DataFrame, test: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Both frames as fit() makes them whatever the parameters: target, scaled vectors, and the training rows' weights.

    A learner() that is fitted on them many times need not weigh and scale them each time.
    """
    rows = train if "row_weight" in train.columns else balanced(train, target)
    scaled = scaler(diffs(train)).fit(rows)
    return scaled.transform(rows).select(target, "row_weight", "_scaled"), scaled.transform(test).select(target, "_scaled")


def fit(kind: str, train: DataFrame, target: str = "target", held: DataFrame | None = None, **params):
    """A model of train's differences. ``held`` rows stop the training of leaf and net models early; others do not look at them."""
    rows = train if "row_weight" in train.columns else balanced(train, target)
    if kind in ("leaf", "net"):
        stop = {"held": held, "patience": 10} if held is not None else {}
        return (boosting if kind == "leaf" else perceptron).fit(rows, diffs(train), target, "row_weight", **stop | params)
    return estimator(kind, diffs(train), target, **params).fit(rows)


def score(model, df: DataFrame, out: str = "p_red") -> DataFrame:
    if isinstance(model, boosting.Booster | perceptron.Perceptron):
        return model.score(df, out)
    keep = df.columns
    return model.transform(df).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(out))


def platt(scored: DataFrame, p: str, target: str = "target"):
    """A function Column -> Column: logistic of one feature, fitted on scored rows."""
    m = Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="_one"), LogisticRegression(featuresCol="_one", labelCol=target)]).fit(scored.select(p, target)).stages[-1]
    a, b = float(m.coefficients[0]), float(m.intercept)
    return lambda c: 1 / (1 + F.exp(-(a * c + b)))


def isotonic(scored: DataFrame, p: str, target: str = "target"):
    """A function Column -> Column: piecewise linear between the fitted model's boundaries, clipped to [0, 1]."""
    m = IsotonicRegression(featuresCol="_one", labelCol="_y").fit(Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="_one")]).fit(scored).transform(scored).withColumn("_y", F.col(target).cast("double")))
    xs, ys = [float(x) for x in m.boundaries], [float(y) for y in m.predictions]

    def apply(c: Column) -> Column:
        out = F.when(c <= xs[0], ys[0])
        for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:], strict=False):
            out = out.when(c <= x1, y0 if x1 == x0 else F.lit(y0) + (c - x0) * ((y1 - y0) / (x1 - x0)))
        return F.least(F.greatest(out.otherwise(ys[-1]), F.lit(0.0)), F.lit(1.0))

    return apply


def vote(scored: DataFrame, weights: dict[str, float], out: str = "p_red") -> DataFrame:
    total = sum(weights.values())
    return scored.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) * (w / total) for c, w in weights.items()]))


def search_weights(scored: DataFrame, columns: list[str], target: str = "target", tries: int = 200, seed: int = 42) -> dict[str, float]:
    """The weights with the best accuracy, of random draws. All tries are one aggregation over the validation rows."""
    rng = random.Random(seed)
    draws = [[1.0] * len(columns)] + [[-math.log(rng.random()) for _ in columns] for _ in range(tries - 1)]
    hit = lambda ws: F.avg(((reduce(lambda a, b: a + b, [F.col(c) * (w / sum(ws)) for c, w in zip(columns, ws, strict=True)]) >= 0.5).cast("int") == F.col(target)).cast("double"))
    best, at = -1.0, 0
    for i in range(0, len(draws), 50):
        row = scored.agg(*[hit(ws).alias(f"t{k}") for k, ws in enumerate(draws[i : i + 50])]).first()
        for k, v in enumerate(row):
            if v is not None and v > best:
                best, at = v, i + k
    return dict(zip(columns, draws[at], strict=True))


def stack(valid: DataFrame, columns: list[str], target: str = "target") -> PipelineModel:
    """A logistic regression over the models' probabilities."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_vector"), LogisticRegression(featuresCol="_vector", labelCol=target)]).fit(valid)


def tune(df: DataFrame, kind: str, grid: list[dict], order: str = "date", target: str = "target", folds: int = 5, gap_days: int = 180, least: tuple[int, int] = (50, 20)) -> tuple[dict, DataFrame]:
    """The parameters of the grid with the least mean Brier score over purged folds, and (params, fold, brier, accuracy) of all.

    A model is fitted on each fold's training rows, which end gap_days before its test rows. At equal
    scores the earlier parameters win. ``df`` is cut into folds once.
    """
    rows = purged_folds(df, order, folds, gap_days, least).persist()
    found = sorted(r.fold for r in rows.select("fold").distinct().collect())
    p, y = F.col("_p"), F.col(target).cast("double")
    out = []
    for at, params in enumerate(grid):
        for fold in found:
            part = rows.where(F.col("fold") == fold)
            scored = score(fit(kind, part.where("role = 'train'"), target, **params), part.where("role = 'test'"), "_p")
            r = scored.agg(F.avg((p - y) ** 2).alias("brier"), F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy")).first()
            out.append((at, str(params), fold, r.brier, r.accuracy))
    rows.unpersist()
    means = {at: sum(r[3] for r in out if r[0] == at) / len(found) for at in range(len(grid))} if found else {}
    best = grid[min(means, key=lambda at: (means[at], at))] if means else grid[0]
    return best, df.sparkSession.createDataFrame([r[1:] for r in out], "params string, fold int, brier double, accuracy double")


def finish_rows(m: DataFrame, methods: DataFrame) -> DataFrame:
    """Matrix rows with ``finish``: 0 knock-out, 1 submission, 2 decision; other endings are left out."""
    named = methods.select("bout_id", finish_class(F.col("method")).alias("finish"))
    return m.join(named, "bout_id").where("finish >= 0")


def fit_finish(train: DataFrame, kind: str = "lr", **params) -> PipelineModel:
    """A model of three classes over finish_rows(), with balanced weights."""
    return fit(kind, train, "finish", **({"classes": 3} if kind == "mlp" else {}), **params)


def score_finish(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds p_ko, p_sub, p_dec and the most likely ``finish_pick``."""
    keep = df.columns
    p = vector_to_array("probability")
    out = model.transform(df).select(*keep, *[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("p_ko", "p_sub", "p_dec"))], F.col("prediction").cast("int").alias("finish_pick"))
    return out


def importance(model, df: DataFrame, features: list[str] | None = None, target: str = "target", repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, drop): the mean loss of accuracy when a feature's values are dealt anew among all rows.

    Every row gets a feature's value from the row that a keyed permutation of the rows' positions names (``donors``);
    all features and repeats are scored in one pass, and no group of rows or order of its own is needed.
    """
    features = features or diffs(df)
    rows = written(positions(df, ["bout_id"]).drop("n"), "placed")
    n = rows.count()
    hit = F.avg(((F.col("_p") >= 0.5).cast("int") == F.col(target)).cast("double"))
    base = score(model, df, "_p").agg(hit).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, drop double")
    dealt = with_donors(rows, n, features, seed, repeats).withColumn("_f", F.explode(F.array(*[F.lit(f) for f in features])))
    dealt = dealt.select("repeat", "_f", *[F.when(F.col("_f") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) if f in features else F.col(f) for f in df.columns])
    each = score(model, dealt, "_p").groupBy("_f", "repeat").agg(hit.alias("a"))
    return each.groupBy(F.col("_f").alias("feature")).agg(F.avg(F.lit(base) - F.col("a")).alias("drop"))


def prune(importances: list[DataFrame], threshold: float, models: int = 3) -> DataFrame:
    """Features whose mean importance is below the threshold and which at least so many models put below it."""
    named = [d.select("feature", F.col("drop").alias(f"m{i}")) for i, d in enumerate(importances)]
    both = reduce(lambda a, b: a.join(b, "feature", "full_outer"), named).na.fill(0.0)
    cols = [F.col(f"m{i}") for i in range(len(named))]
    mean, below = reduce(lambda a, b: a + b, cols) / len(cols), reduce(lambda a, b: a + b, [(c < threshold).cast("int") for c in cols])
    return both.select("feature", mean.alias("mean"), below.alias("below")).where((F.col("mean") < threshold) & (F.col("below") >= models))


def adversarial(old: DataFrame, new: DataFrame, seed: int = 42) -> DataFrame:
    """(auc, verdict): how well a model tells new rows from old ones. Over 0.65 drifts, from 0.55 on it is mild."""
    features = [c for c in diffs(old) if c in new.columns]
    both = old.select("bout_id", *features).withColumn("target", F.lit(0)).unionByName(new.select("bout_id", *features).withColumn("target", F.lit(1)))
    test = F.pmod(F.xxhash64("bout_id", F.lit(seed)), F.lit(10)) < 3
    model = fit("gbt", both.where(~test))
    a = auc(score(model, both.where(test), "p_red").withColumnRenamed("target", "y"))
    return a.withColumn("verdict", F.when(F.col("auc") > 0.65, "drift").when(F.col("auc") >= 0.55, "mild").otherwise("none"))


def train_all(train: DataFrame, valid: DataFrame, kinds: tuple[str, ...] = KINDS, params: dict[str, dict] | None = None) -> dict:
    """Models by kind, each with a Platt calibration fitted on rows that neither training nor test use; the same rows stop
    the training of leaf and net models."""
    out = {}
    for k in kinds:
        m = fit(k, train, held=valid, **(params or {}).get(k, {}))
        out[k] = (m, platt(score(m, valid, "_p"), "_p"))
    return out


def score_all(models: dict, df: DataFrame) -> DataFrame:
    for k, (m, calibrate) in models.items():
        df = score(m, df, f"p_{k}")
        df = df.withColumn(f"p_{k}", calibrate(F.col(f"p_{k}")))
    return df
