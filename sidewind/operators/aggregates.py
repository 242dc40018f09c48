"""Reports and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import div, positive
from ..functions.scalar import confidence, decimal_odds, implied, kelly
from .joins import small


def record(side_rows: DataFrame) -> DataFrame:
    """Wins, losses and draws of each participant."""
    return side_rows.groupBy("participant_id").agg(
        F.count_if(F.col("is_win") == 1).alias("wins"), F.count_if(F.col("is_loss") == 1).alias("losses"),
        F.count_if((F.col("is_win") == 0) & (F.col("is_loss") == 0)).alias("draws"), F.count("*").alias("bouts"),
    )


def method_rates(side_rows: DataFrame) -> DataFrame:
    won = F.col("is_win") == 1
    n = lambda c: F.count_if(won & c)
    m = F.col("method")
    return side_rows.groupBy("participant_id").agg(
        *[div(n(c), F.count_if(won)).alias(k) for k, c in (("ko_rate", m == "KO/TKO"), ("sub_rate", m == "Submission"), ("dec_rate", m.startswith("Decision")))]
    )


def career_totals(side_rows: DataFrame, sums: list[str]) -> DataFrame:
    return side_rows.groupBy("participant_id").agg(*[F.sum(c).alias(c) for c in sums], F.avg("landed").alias("avg_landed"), div(F.sum("landed"), F.sum("attempted")).alias("accuracy"))


def report(scored: DataFrame, by: str, total: bool = True) -> DataFrame:
    """Rows, hits and accuracy by a column; with total, a last row where it is null."""
    grouped = scored.rollup(by) if total else scored.groupBy(by)
    return grouped.agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("n_correct"), F.avg("correct").alias("accuracy"))


def report_having(scored: DataFrame, by: str, least: int = 30) -> DataFrame:
    return report(scored, by, total=False).where(F.col("n") >= least).orderBy(F.desc("accuracy"), by)


def brier_report(scored: DataFrame, p: str = "p_red", y: str = "y") -> DataFrame:
    p, y = F.col(p), F.col(y)
    return scored.agg(
        F.count("*").alias("n"), F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"), F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("accuracy"),
        F.avg(confidence(p)).alias("mean_confidence"), F.greatest(F.avg(y), 1 - F.avg(y)).alias("naive"),
    )


def calibration(scored: DataFrame, bins: int = 10, p: str = "p_red", y: str = "y") -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scored.groupBy(b).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("share"))


def confusion(scored: DataFrame, p: str = "p_red", y: str = "y") -> DataFrame:
    return scored.groupBy(F.col(y).alias("actual"), (F.col(p) >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def auc(scored: DataFrame, p: str = "p_red", y: str = "y", bins: int = 4096) -> DataFrame:
    """Area under the ROC curve by rank sums.

    Scores are folded to distinct values; how many negatives lie below a value is the sum over lower
    bins, a table of at most ``bins`` rows, and a running sum within its own bin, so no window holds all.
    """
    g = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    g = g.withColumn("_bin", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * bins))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    by_bin = g.groupBy("_bin").agg(F.sum("neg").alias("neg"))
    offsets = by_bin.select("_bin", before(Window.orderBy("_bin")).alias("_lower"))
    inside = g.withColumn("_in", before(Window.partitionBy("_bin").orderBy("p")))
    u = inside.join(F.broadcast(offsets), "_bin").select("pos", "neg", (F.col("pos") * (F.col("_lower") + F.col("_in") + F.col("neg") / 2)).alias("u"))
    return u.agg(F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def bets(scored: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row per bet: the side whose edge passes the threshold; if both do, the larger edge, ties to red."""
    dr, db = decimal_odds(F.col("odds_red")), decimal_odds(F.col("odds_blue"))
    e = scored.withColumns({"edge_red": F.col("p_red") - implied(F.col("odds_red")), "edge_blue": 1 - F.col("p_red") - implied(F.col("odds_blue"))})
    red = (F.col("edge_red") >= threshold) & ((F.col("edge_blue") < threshold) | (F.col("edge_red") >= F.col("edge_blue")))
    blue = (F.col("edge_blue") >= threshold) & ~red
    e = e.withColumn("bet", F.when(red, "red").when(blue, "blue")).where("bet IS NOT NULL")
    e = e.withColumns({"edge": F.when(F.col("bet") == "red", F.col("edge_red")).otherwise(F.col("edge_blue")), "dec": F.when(F.col("bet") == "red", dr).otherwise(db), "won": F.when(F.col("bet") == "red", F.col("y")).otherwise(1 - F.col("y"))})
    stake = kelly(F.col("edge"), F.col("dec"))
    profit = F.when(F.col("won") == 1, F.col("dec") - 1).otherwise(-1.0)
    return e.withColumns({"stake": stake, "profit": profit, "kelly_profit": stake * profit})


def bet_report(bet_rows: DataFrame, by: str | None = None) -> DataFrame:
    g = bet_rows.groupBy(by) if by else bet_rows.groupBy()
    return g.agg(
        F.count("*").alias("n_bets"), F.avg("won").alias("win_rate"), F.avg("profit").alias("flat_roi"),
        div(F.sum("kelly_profit"), F.sum("stake")).alias("kelly_roi"), F.avg("edge").alias("avg_edge"), F.avg("dec").alias("avg_odds"),
    )


def event_score(scored: DataFrame, high: float = 0.65, stake_from: float = 0.55) -> DataFrame:
    """Hits, the high-confidence part, and profit of one unit on picks from stake_from. A hit without odds earns 0."""
    conf = confidence(F.col("p_red"))
    pick_odds = F.when(F.col("p_red") >= 0.5, F.col("odds_red")).otherwise(F.col("odds_blue"))
    profit = F.when(F.col("correct") == 1, F.coalesce(decimal_odds(pick_odds) - 1, F.lit(0.0))).otherwise(-1.0)
    return scored.agg(
        F.count("*").alias("n"), F.count_if(F.col("correct") == 1).alias("n_correct"), F.count_if(F.col("y").isNull()).alias("n_excluded"),
        F.count_if(conf >= high).alias("n_high"), F.count_if((conf >= high) & (F.col("correct") == 1)).alias("n_high_correct"),
        F.count_if(conf >= stake_from).alias("n_staked"), F.sum(F.when(conf >= stake_from, profit)).alias("net"),
    )


def group_mean(c: Column, by: str) -> Column:
    return F.avg(c).over(Window.partitionBy(by))


def shrink(df: DataFrame, value: str, n: str, by: str, strength: float = 5.0) -> DataFrame:
    """Adds <value>_shrunk: (n * value + strength * mean of the group) / (n + strength). The means are aggregated with map-side combination, so a large group costs one row per task."""
    means = df.groupBy(by).agg(F.avg(value).alias("_mean"))
    return df.join(small(means), by, "left").withColumn(f"{value}_shrunk", (F.col(n) * F.col(value) + strength * F.col("_mean")) / (F.col(n) + strength)).drop("_mean")


def group_std(df: DataFrame, value: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.stddev_samp(positive(F.col(value))).alias(f"{value}_std"), F.count(positive(F.col(value))).alias("n"))


def league_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(positive(F.col(c))).alias(c) for c in columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def impute_debut(df: DataFrame, value: str, seen: str, by: str) -> DataFrame:
    """Rows without history take the mean of their group's rows with history, else the overall one."""
    known = df.where(F.col(seen) > 0)
    means = known.groupBy(by).agg(F.avg(value).alias("_g"))
    overall = known.agg(F.avg(value).alias("_all"))
    return df.join(means, by, "left").crossJoin(F.broadcast(overall)).withColumn(value, F.when(F.col(seen) > 0, F.col(value)).otherwise(F.coalesce("_g", "_all"))).drop("_g", "_all")


def violations(bouts: DataFrame, side_rows: DataFrame) -> DataFrame:
    """Integrity: (check, n) of bouts without two sides, orphan sides, repeated bouts, null dates and foreign winners."""
    per = side_rows.groupBy("bout_id").agg(F.count("*").alias("n")).where("n <> 2")
    orphans = side_rows.join(bouts.select("bout_id"), "bout_id", "left_anti")
    repeated = bouts.groupBy("bout_id").agg(F.count("*").alias("n")).where("n > 1")
    foreign = bouts.where("winner_id IS NOT NULL AND winner_id <> r_id AND winner_id <> b_id")
    checks = {"sides_not_two": per, "orphan_sides": orphans, "repeated_bouts": repeated, "null_dates": bouts.where("date IS NULL"), "foreign_winners": foreign}
    out = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have a value, and their share."""
    return rows.agg(F.count("*").alias("n"), F.count(column).alias("n_matched"), div(F.count(column), F.count("*")).alias("share"))


def leak_share(features: DataFrame, column: str, history: str = "bouts_before") -> DataFrame:
    """Share of first rows whose history column is not 0: a leak if above 0."""
    first = F.col(history) == 0
    return features.agg(F.count_if(first).alias("n_first"), div(F.count_if(first & (F.col(column) != 0)), F.count_if(first)).alias("share"))


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Rows by value and their share of all; the values' counts are summed, not the rows again."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select(by, "n", (F.col("n") / F.col("_all")).alias("share"))


def symmetry(matrix: DataFrame) -> DataFrame:
    """(column, mean, std, ok) of each difference column: the mean should be within one deviation of 0. One aggregation for all."""
    diffs = [c for c in matrix.columns if c.endswith("_diff")]
    one = matrix.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in diffs])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std")) for c in diffs])
    return one.select(F.inline(pairs)).withColumn("ok", F.abs("mean") < F.col("std"))
