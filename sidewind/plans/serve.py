"""Serving frames: requests in, rows out. What a service would answer one by one is answered in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.text import contains_ci, is_finish, no_contest
from ..operators.aggregates import method_rates, record
from ..operators.joins import head_to_head, latest_per_key
from ..operators.models import score_all, vote
from ..operators.windows import decided_mean, last_rows, streaks
from .features import FEATURES


def search(dim: DataFrame, q: str, name: str = "name", limit: int = 20) -> DataFrame:
    """Names that hold q in either case, at least two characters, the first ``limit`` by name."""
    if len(q) < 2:
        return dim.limit(0)
    return dim.where(contains_ci(F.col(name), q)).orderBy(name).limit(limit)


def profile(side_rows: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """One row per participant: record, method rates, last bout, current rating."""
    newest = latest_per_key(side_rows.select("participant_id", "ts", "bout_id", "date", "class"), ["participant_id"], ["ts", "bout_id"])
    out = record(side_rows).join(method_rates(side_rows), "participant_id").join(newest.select("participant_id", F.col("date").alias("last_date"), F.col("class").alias("last_class")), "participant_id")
    return out.join(ratings.select("participant_id", "elo"), "participant_id", "left") if ratings is not None else out


def recent_form(side_rows: DataFrame, n: int = 5) -> DataFrame:
    """The newest n (1 to 20) bouts of each participant with W, L or D; no contests by name (NC)."""
    nc = no_contest(F.col("method"))
    result = F.when(F.col("is_win") == 1, "W").when(F.col("is_loss") == 1, "L").when(nc, "NC").otherwise("D")
    return last_rows(side_rows, min(max(n, 1), 20)).select("participant_id", "bout_id", "date", "opponent_id", "method", result.alias("result"), F.col("_n").alias("n"))


def form(side_rows: DataFrame, n: int = 3) -> DataFrame:
    """(participant_id, recent_win, recent_finish, win_streak): shares among the last n decided bouts, and wins in a row up to
    the last; bouts without a winner are skipped. A participant without a decided bout has zeros."""
    rows = streaks(side_rows).withColumns({"_win": decided_mean(F.col("is_win"), n, True), "_finish": decided_mean(is_finish(F.col("method")), n, True)})
    newest = latest_per_key(rows.select("participant_id", "ts", "bout_id", "_win", "_finish", "win_streak_after"), ["participant_id"], ["ts", "bout_id"])
    return newest.select("participant_id", F.col("_win").alias("recent_win"), F.col("_finish").alias("recent_finish"), F.col("win_streak_after").alias("win_streak"))


def compare(profiles: DataFrame, pairs: DataFrame, bouts: DataFrame) -> DataFrame:
    """pairs(red, blue) with both records, the differences, and the number of their bouts."""
    cols = ["wins", "losses", "draws"]
    r = profiles.select(F.col("participant_id").alias("red"), *[F.col(c).alias(f"r_{c}") for c in cols])
    b = profiles.select(F.col("participant_id").alias("blue"), *[F.col(c).alias(f"b_{c}") for c in cols])
    met = bouts.groupBy(F.least("r_id", "b_id").alias("_low"), F.greatest("r_id", "b_id").alias("_high")).agg(F.count("*").alias("met"))
    out = pairs.join(r, "red", "left").join(b, "blue", "left").withColumns({"_low": F.least("red", "blue"), "_high": F.greatest("red", "blue")}).join(met, ["_low", "_high"], "left")
    return out.select("red", "blue", *[F.col(f"{s}_{c}") for c in cols for s in ("r", "b")], *[(F.col(f"r_{c}") - F.col(f"b_{c}")).alias(f"{c}_diff") for c in cols], F.coalesce("met", F.lit(0)).alias("met"))


def request_matrix(requests: DataFrame, state: DataFrame) -> DataFrame:
    """requests(request_id, red, blue) with differences of both sides' latest state; error says what is missing."""
    keep = ["participant_id", *FEATURES]
    r = state.select(*keep).select(F.col("participant_id").alias("red"), *[F.col(f).cast("double").alias(f"r_{f}") for f in FEATURES])
    b = state.select(*keep).select(F.col("participant_id").alias("blue"), *[F.col(f).cast("double").alias(f"b_{f}") for f in FEATURES])
    out = requests.join(r, "red", "left").join(b, "blue", "left")
    error = F.when(F.col("red") == F.col("blue"), "same participant").when(F.col("r_bouts_before").isNull(), "red not found").when(F.col("b_bouts_before").isNull(), "blue not found")
    return out.select("request_id", "red", "blue", error.alias("error"), *[F.coalesce(d, F.lit(0.0)).alias(f"{f}_diff") for d, f in zip(sc.differences(FEATURES), FEATURES, strict=True)])


def predict(models: dict, requests: DataFrame, state: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(request_id, red, blue, p_red, p_blue, pick, confidence, error), one row per request; with an error the rest is null."""
    weights = weights or {f"p_{k}": 1.0 for k in models}
    out = vote(score_all(models, request_matrix(requests, state)), weights)
    ok = F.col("error").isNull()
    p = F.when(ok, F.col("p_red"))
    return out.select("request_id", "red", "blue", p.alias("p_red"), (1 - p).alias("p_blue"), F.when(ok, F.when(F.col("p_red") >= 0.5, F.col("red")).otherwise(F.col("blue"))).alias("pick"), sc.confidence(p).alias("confidence"), "error")


def priced(predictions: DataFrame) -> DataFrame:
    """Adds implied and fair probabilities, edges and stakes to predictions with odds_red and odds_blue."""
    ir, ib = sc.implied(F.col("odds_red")), sc.implied(F.col("odds_blue"))
    er, eb = F.col("p_red") - ir, 1 - F.col("p_red") - ib
    return predictions.withColumns({"implied_red": ir, "implied_blue": ib, "fair_red": sc.fair(ir, ib), "edge_red": er, "edge_blue": eb, "stake_red": sc.kelly(er, sc.decimal_odds(F.col("odds_red"))), "stake_blue": sc.kelly(eb, sc.decimal_odds(F.col("odds_blue")))})


def meetings(bouts: DataFrame, a, b) -> DataFrame:
    return head_to_head(bouts, a, b)
