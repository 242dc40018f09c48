"""Ordered, leakage-safe windows per participant.

All share one timeline (participant, then ts and bout), so Catalyst plans one exchange and one sort
for any number of them. A frame that ends one row before the current one is what "before this bout"
means; ``current=True`` gives the online variant that includes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import div

#: What lies before the rows that an exponentially weighted mean looks at weighs less than this.
EWMA_REST = 1e-16


def timeline() -> WindowSpec:
    return Window.partitionBy("participant_id").orderBy("ts", "bout_id")


def prior(current: bool = False) -> WindowSpec:
    return timeline().rowsBetween(Window.unboundedPreceding, 0 if current else -1)


def last(n: int, current: bool = False) -> WindowSpec:
    return timeline().rowsBetween(1 - n, 0) if current else timeline().rowsBetween(-n, -1)


def prior_sum(c: Column, current: bool = False) -> Column:
    return F.coalesce(F.sum(c).over(prior(current)), F.lit(0))


def prior_mean(c: Column, current: bool = False) -> Column:
    return F.coalesce(F.avg(c).over(prior(current)), F.lit(0.0))


def prior_ratio(a: Column, b: Column, scale: float = 1.0, current: bool = False) -> Column:
    return div(prior_sum(a, current) * F.lit(scale), prior_sum(b, current))


def bouts_before() -> Column:
    return F.row_number().over(timeline()) - 1


def last_mean(c: Column, n: int, default: float | None = 0.0, current: bool = False) -> Column:
    out = F.avg(c).over(last(n, current))
    return out if default is None else F.coalesce(out, F.lit(default))


def last_std(c: Column, n: int, current: bool = False) -> Column:
    """Sample deviation; 0 with fewer than two rows."""
    return F.coalesce(F.nanvl(F.stddev_samp(c).over(last(n, current)), F.lit(0.0)), F.lit(0.0))


def slope(c: Column, n: int = 5, need: int = 5, current: bool = False) -> Column:
    """Slope of the last n values against their order; 0 with fewer than ``need``, which online states set to 2."""
    w = last(n, current)
    out = F.regr_slope(c, F.col("_at")).over(w)
    return F.when(F.count(c).over(w) >= need, F.coalesce(out, F.lit(0.0))).otherwise(0.0)


def with_order(df):
    """Adds the running number that slope() takes as x."""
    return df.withColumn("_at", F.row_number().over(timeline()).cast("double"))


def ewma(c: Column, span: int = 5, current: bool = False) -> Column:
    """Exponentially weighted mean (weights adjusted at the start); null with no row."""
    q = 1 - 2 / (span + 1)
    rows = math.ceil(math.log(EWMA_REST) / math.log(q)) if q else 1
    values = F.collect_list(c).over(timeline().rowsBetween(-rows, 0 if current else -1))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    return F.aggregate(
        values, zero, lambda a, v: F.struct((a.n * q + v).alias("n"), (a.d * q + 1).alias("d")), lambda a: F.try_divide(a.n, a.d)
    )


def ewmas(columns: list[Column], span: int = 5, current: bool = False) -> Column:
    """Exponentially weighted means of several columns in one array, over one frame; null with no row. Null values count as 0."""
    q = 1 - 2 / (span + 1)
    rows = math.ceil(math.log(EWMA_REST) / math.log(q)) if q else 1
    values = F.collect_list(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])).over(timeline().rowsBetween(-rows, 0 if current else -1))
    zero = F.struct(F.array(*[F.lit(0.0) for _ in columns]).alias("n"), F.lit(0.0).alias("d"))
    step = lambda a, v: F.struct(F.zip_with(a.n, v, lambda x, y: x * q + y).alias("n"), (a.d * q + 1).alias("d"))
    return F.aggregate(values, zero, step, lambda a: F.when(a.d > 0, F.transform(a.n, lambda x: x / a.d)))


def is_decided(win: str = "is_win", loss: str = "is_loss") -> Column:
    """Bouts with a winner. The others, no contests, say nothing about form, and end no streak."""
    return (F.col(win) == 1) | (F.col(loss) == 1)


def decided_mean(c: Column, n: int, current: bool = False, decided: Column | None = None) -> Column:
    """Mean of c over the last n decided bouts; 0 with none.

    The mean is had where a bout was decided, over the decided ones alone, and carried from there to
    the undecided rows after it. Both windows share the participant's exchange.
    """
    decided = is_decided() if decided is None else decided
    alone = Window.partitionBy("participant_id", decided).orderBy("ts", "bout_id").rowsBetween(1 - n, 0)
    after = F.when(decided, F.avg(c).over(alone))
    return F.coalesce(F.last(after, ignorenulls=True).over(prior(current)), F.lit(0.0))


def streaks(df, win: str = "is_win", loss: str = "is_loss", draw: Column | None = None):
    """Adds win_streak and loss_streak before each bout, and <streak>_after it.

    Rows that are neither won nor lost are skipped; those that ``draw`` names, if it is given, end both
    streaks. A streak is the distance to the last counted row that ended it, so the timeline's own sort serves.
    """
    counted = is_decided(win, loss) if draw is None else is_decided(win, loss) | draw
    df = df.withColumn("_row", F.sum(counted.cast("int")).over(prior(True)))
    for out, c in (("win_streak", win), ("loss_streak", loss)):
        ended = F.max(F.when(counted & (F.col(c) != 1), F.col("_row"))).over(prior(True))
        df = df.withColumn(f"{out}_after", (F.col("_row") - F.coalesce(ended, F.lit(0))).cast("long"))
    for out in ("win_streak", "loss_streak"):
        df = df.withColumn(out, F.coalesce(F.lag(f"{out}_after").over(timeline()), F.lit(0)).cast("long"))
    return df.drop("_row")


def record_with_offset(df, wins: str = "total_wins", losses: str = "total_losses"):
    """Adds wins and losses before each bout where ``total_wins`` and ``total_losses`` are a participant's whole record,
    which may count bouts that df lacks: what df's own bouts do not explain came before all of them."""
    every = Window.partitionBy("participant_id")
    of = lambda c, total: (prior_sum(F.col(c)) + F.col(total) - F.sum(c).over(every)).cast("long")
    return df.withColumns({"wins": of("is_win", wins), "losses": of("is_loss", losses)})


def longest_before(c: Column) -> Column:
    return F.coalesce(F.max(c).over(prior()), F.lit(0))


def days_since_last(date: str = "date") -> Column:
    return F.datediff(date, F.lag(date).over(timeline()))


def last_rows(df, n: int):
    """The newest n rows of each participant."""
    w = Window.partitionBy("participant_id").orderBy(F.desc("ts"), F.desc("bout_id"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
