"""Chronological splits, purged folds and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import positions


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (0, 1, ... in order) and n. Rows without a time come first. No day or other group is one task's work (``scans``)."""
    return positions(df, order)


def time_split(df: DataFrame, order: list[str], shares: tuple[float, ...] = (0.8, 0.2), names: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Adds split: the first share of rows in order, then the next, ..."""
    out, edge = None, 0.0
    rows = numbered(df, order)
    for share, name in zip(shares[:-1], names[:-1], strict=True):
        edge += share
        inside = F.col("pos") < F.floor(F.col("n") * F.lit(round(edge, 9)))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return rows.withColumn("split", out.otherwise(names[-1])).drop("pos", "n")


def expanding_folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """(fold, role) for each row: test blocks of n // (k + 1) rows, each trained on all rows before it."""
    rows = numbered(df, order)
    size = F.floor(F.col("n") / (k + 1))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("n") - size * (k - F.col("fold") + 1)
    role = F.when(F.col("pos") < start, "train").when(F.col("pos") < start + size, "test")
    return rows.withColumn("role", role).where("role IS NOT NULL").drop("pos", "n")


def purged_folds(df: DataFrame, date: str, k: int = 5, gap_days: int = 180, least: tuple[int, int] = (50, 20)) -> DataFrame:
    """(fold, role): the date range is cut in k + 1 equal parts; fold i tests part i and trains on what
    ends gap_days before it. Folds with too few rows are left out."""
    span = df.agg(F.min(date).alias("_first"), F.datediff(F.max(date), F.min(date)).alias("_days"))
    rows = df.crossJoin(F.broadcast(span)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    width = F.col("_days") / F.lit(float(k + 1))
    at = F.datediff(F.col(date), F.col("_first")).cast("double")
    start, stop = width * F.col("fold"), width * (F.col("fold") + 1)
    test = (at >= start) & ((at < stop) | ((F.col("fold") == k) & (at <= stop)))
    role = F.when(test, "test").when(at < start - gap_days, "train")
    rows = rows.withColumn("role", role).where("role IS NOT NULL").drop("_first", "_days")
    sizes = rows.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("_train"), F.count_if(F.col("role") == "test").alias("_test"))
    good = sizes.where((F.col("_train") >= least[0]) & (F.col("_test") >= least[1])).select("fold")
    return rows.join(F.broadcast(good), "fold", "left_semi")
