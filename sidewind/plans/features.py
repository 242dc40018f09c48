"""Feature matrices: one long frame with all windows, widened once.

Raw rows are never written to; features are a table of their own. With ``current`` the same
expressions give a participant's state after the last bout, so serving cannot drift from training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.safe import scrub
from ..functions.text import is_finish
from ..operators import ratings
from ..operators import windows as w
from ..operators.joins import latest_per_key
from ..operators.longform import mirrored, widen

#: Features per side; each gives a difference.
FEATURES = [
    "bouts_before", "wins", "losses", "win_streak", "loss_streak", "longest", "accuracy", "td_accuracy", "landed_pm", "absorbed_pm", "td_per_15", "str_def", "td_def",
    "recent_win", "recent_finish", "ko_share", "sub_share", "dec_share", "idle", "ko_losses", "kd_received", "ewma_accuracy", "ewma_landed_pm", "std_accuracy", "slope_accuracy", "rounds", "titles",
]


def long_features(side_rows: DataFrame, current: bool = False, as_of: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Per side row, what was known before the bout (with current: including it, at the day ``as_of``, today if not given).

    idle is the number of days since the last bout; before a first bout, the median of all such gaps. ``more`` are further
    columns over the same windows.
    """
    c = F.col
    gap = w.days_since_last()
    if current:
        idle = F.greatest(F.datediff(F.current_date() if as_of is None else as_of, "date"), F.lit(0)).cast("double")
    else:
        # Gaps are whole days, so the exact median needs one count per number of days.
        median = side_rows.select(gap.alias("_gap")).agg(F.coalesce(F.median("_gap"), F.lit(365.0)).alias("_median"))
        side_rows = side_rows.crossJoin(F.broadcast(median))
        idle = F.coalesce(gap.cast("double"), c("_median"))
    base = w.with_order(w.streaks(side_rows)).withColumns({
        "_acc": sc.accuracy(c("landed"), c("attempted")), "_pm": sc.per_minute(c("landed"), c("seconds")),
        "_finish": ((c("is_win") == 1) & (is_finish(c("method")) == 1)).cast("int"), "_ko_loss": ((c("is_loss") == 1) & (c("method") == "KO/TKO")).cast("int"),
    })
    won = lambda m: ((c("is_win") == 1) & m).cast("int")
    s = lambda x: w.prior_sum(x, current)
    wins = F.greatest(s(c("is_win")), F.lit(1))
    streak = (lambda n: c(f"{n}_after")) if current else c
    return base.select(
        "bout_id", "side", "participant_id", "ts", "date", "class",
        (w.bouts_before() + (1 if current else 0)).alias("bouts_before"), s(c("is_win")).alias("wins"), s(c("is_loss")).alias("losses"),
        streak("win_streak").alias("win_streak"), streak("loss_streak").alias("loss_streak"), F.coalesce(F.max("win_streak_after").over(w.prior(current)), F.lit(0)).alias("longest"),
        w.prior_ratio(c("landed"), c("attempted"), current=current).alias("accuracy"), w.prior_ratio(c("td_landed"), c("td_attempted"), current=current).alias("td_accuracy"),
        w.prior_ratio(c("landed"), c("seconds"), 60.0, current).alias("landed_pm"), w.prior_ratio(c("opp_landed"), c("seconds"), 60.0, current).alias("absorbed_pm"), w.prior_ratio(c("td_landed"), c("seconds"), 900.0, current).alias("td_per_15"),
        sc.defense_pct(s(c("opp_landed")), s(c("opp_attempted"))).alias("str_def"), sc.defense_pct(s(c("opp_td_landed")), s(c("opp_td_attempted"))).alias("td_def"),
        w.decided_mean(c("is_win"), 3, current).alias("recent_win"), w.decided_mean(c("_finish"), 3, current).alias("recent_finish"),
        (s(won(c("method") == "KO/TKO")) / wins).alias("ko_share"), (s(won(c("method") == "Submission")) / wins).alias("sub_share"), (s(won(c("method").startswith("Decision"))) / wins).alias("dec_share"),
        idle.alias("idle"), s(c("_ko_loss")).alias("ko_losses"), s(c("opp_kd")).alias("kd_received"),
        F.coalesce(w.ewma(c("_acc"), current=current), F.lit(0.0)).alias("ewma_accuracy"), F.coalesce(w.ewma(c("_pm"), current=current), F.lit(0.0)).alias("ewma_landed_pm"),
        w.last_std(c("_acc"), 5, current).alias("std_accuracy"), w.slope(c("_acc"), 5, 2 if current else 5, current).alias("slope_accuracy"),
        s(sc.rounds_fought(c("seconds"))).alias("rounds"), s(c("title")).alias("titles"),
        *[x.alias(n) for n, x in (more or {}).items()],
    )


def matrix(bouts: DataFrame, side_rows: DataFrame, since: str | None = None, debuts: bool = False) -> DataFrame:
    """bout_id, date, class, target and the differences, for decided bouts. Filters come after the windows, whose frames they would change."""
    wide = widen(long_features(side_rows), ["bout_id"], FEATURES)
    b = bouts.select("bout_id", "ts", "date", "class", F.col("red_win").alias("target"), "odds_red", "odds_blue").where("target IS NOT NULL")
    out = b.join(wide, "bout_id")
    if not debuts:
        out = out.where("r_bouts_before > 0 AND b_bouts_before > 0")
    if since:
        out = out.where(F.col("date") >= F.lit(since).cast("date"))
    return out.select("bout_id", "ts", "date", "class", "target", "odds_red", "odds_blue", *[scrub(d).alias(f"{f}_diff") for d, f in zip(sc.differences(FEATURES), FEATURES, strict=True)])


def with_ratings(m: DataFrame, bouts: DataFrame, side_rows: DataFrame) -> DataFrame:
    """Adds elo, class_elo, glicko and sos differences. Each rating is one fold, read once, and joined by bout."""
    rated = ratings.elo_global(bouts)
    by_class = ratings.elo_by_class(bouts).select("bout_id", (F.col("elo_r") - F.col("elo_b")).alias("class_elo_diff"))
    glicko = ratings.glicko_by_class(bouts).select("bout_id", (F.col("r_rating") - F.col("b_rating")).alias("glicko_diff"), (F.col("r_rd") - F.col("b_rd")).alias("glicko_rd_diff"))
    sos = widen(ratings.strength_of_schedule(side_rows, rated), ["bout_id"], ["elo", "sos"])
    sos = sos.select("bout_id", (F.col("r_elo") - F.col("b_elo")).alias("elo_diff"), (F.col("r_sos") - F.col("b_sos")).alias("sos_diff"))
    return m.join(sos, "bout_id", "left").join(by_class, "bout_id", "left").join(glicko, "bout_id", "left")


def snapshot_row(wide: DataFrame, stats: list[str], keep: list[str]) -> DataFrame:
    """The wide master row: R_ and B_ columns, and <stat>_dif as blue minus red (the opposite sign of _diff)."""
    return wide.select(*keep, *[F.col(f"r_{s}").alias(f"R_{s}") for s in stats], *[F.col(f"b_{s}").alias(f"B_{s}") for s in stats], *[(F.col(f"b_{s}") - F.col(f"r_{s}")).alias(f"{s}_dif") for s in stats])


def augmented(m: DataFrame) -> DataFrame:
    return mirrored(m)


def latest_state(side_rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per participant: the features after the last bout, at the day ``as_of``, today if not given."""
    return latest_per_key(long_features(side_rows, current=True, as_of=as_of).drop("side"), ["participant_id"], ["ts", "bout_id"])
