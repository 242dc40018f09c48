"""Between the two shapes of a bout: one row with both sides, and one row per side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(bouts: DataFrame, stats: list[str], keep: list[str]) -> DataFrame:
    """One row per side from one scan: the side's own stats, and its opponent's as opp_<stat>.

    The opponent's numbers come along from the wide row, so no self-join is needed for them.
    """

    def side(me: str, other: str) -> Column:
        return F.struct(
            F.lit(me).alias("side"), F.col(f"{me}_id").alias("participant_id"), F.col(f"{other}_id").alias("opponent_id"),
            *[F.col(f"{me}_{s}").alias(s) for s in stats], *[F.col(f"{other}_{s}").alias(f"opp_{s}") for s in stats],
        )

    out = bouts.select(*keep, F.inline(F.array(side("r", "b"), side("b", "r"))))
    won = F.col("winner_id").isNotNull()
    return out.withColumn("is_win", (won & (F.col("winner_id") == F.col("participant_id"))).cast("int")).withColumn("is_loss", (won & (F.col("winner_id") != F.col("participant_id"))).cast("int"))


def widen(side_rows: DataFrame, keep: list[str], stats: list[str]) -> DataFrame:
    """One row per bout with r_ and b_ columns, by one aggregation instead of two joins."""
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    return side_rows.groupBy(*keep).agg(*[pick(s, c) for c in ["participant_id", *stats] for s in ("r", "b")])


def opponent_rows(side_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds opp_<column> by the opponent's row of the same bout (for columns computed after sides())."""
    other = side_rows.select("bout_id", F.col("participant_id").alias("opponent_id"), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return side_rows.join(other, ["bout_id", "opponent_id"], "left")


def mirrored(matrix: DataFrame, target: str = "target") -> DataFrame:
    """The rows and their mirror images: differences negated, target flipped."""
    flip = [(-F.col(c)).alias(c) if c.endswith("_diff") else (1 - F.col(c)).alias(c) if c == target else F.col(c) for c in matrix.columns]
    return matrix.unionByName(matrix.select(*flip))


def aligned(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """These columns in this order, those that df lacks filled."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def stat_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns with a prefix that hold measures, not ids or names."""
    return [c for c in df.columns if c.startswith(prefix) and not c.endswith(("_id", "_name"))]


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])
