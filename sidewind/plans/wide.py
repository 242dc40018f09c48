"""The wide feature matrix: target zones, positions, first rounds, opponents' quality, body, stance, ranks, class.

It adds to ``features`` what a side's zone counts, biographies and ranks give. Side rows need, beside the
usual measures, ``<zone>_landed`` and ``<zone>_attempted`` (and their opp_ counterparts) for ZONES, ``reversals``,
``r1_seconds``, ``r1_landed``, ``r1_ctrl`` and ``r1_reversals``.

All of it shares the participants' timeline. Only the opponents' quality needs a second look at it: what
an opponent's defense was before a bout comes by the bout, and its mean over a participant's earlier
bouts is taken in turn. The first look moves a few columns only, and rows are wide just once between
machines, when both sides of a bout meet: numbers that a row itself gives (``derived``) are made after it
was dealt by participant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.safe import div, positive, scrub
from ..operators import windows as w
from ..operators.joins import small
from ..operators.longform import widen
from .features import FEATURES, long_features

ZONES = ("head", "body", "leg", "dist", "clinch", "ground")
#: Exponentially weighted means of a bout's own numbers, by feature.
EWMAS = {
    "ewma_td_acc": lambda c: sc.accuracy(c("td_landed"), c("td_attempted")), "ewma_head_acc": lambda c: sc.accuracy(c("head_landed"), c("head_attempted")),
    "ewma_body_acc": lambda c: sc.accuracy(c("body_landed"), c("body_attempted")), "ewma_dist_acc": lambda c: sc.accuracy(c("dist_landed"), c("dist_attempted")),
    "ewma_td_avg": lambda c: div(c("td_landed") * 900.0, c("seconds")), "ewma_sapm": lambda c: div(c("opp_landed") * 60.0, c("seconds")), "ewma_clinch_per": lambda c: div(c("clinch_landed"), c("landed")),
    "ewma_sub_att": lambda c: c("sub_att"), "ewma_kd_received": lambda c: c("opp_kd"), "ewma_reversals": lambda c: c("reversals"),
    "ewma_ctrl_r1": lambda c: div(c("r1_ctrl"), c("r1_seconds")), "ewma_splm_r1": lambda c: div(c("r1_landed") * 60.0, c("r1_seconds")), "ewma_reversals_r1": lambda c: c("r1_reversals"),
}
#: Stats that are put in proportion to the opponents' defense: own feature, defense.
ADJUSTED = {"opp_adj_splm": ("landed_pm", "str_def"), "opp_adj_td_avg": ("td_per_15", "td_def"), "opp_adj_head_acc": ("head_acc", "head_def"), "opp_adj_body_acc": ("body_acc", "body_def"), "opp_adj_dist_acc": ("dist_acc", "dist_def")}
#: What was landed and attempted against a side, by its defense.
DEFENSES = {"str_def": ("opp_landed", "opp_attempted"), "td_def": ("opp_td_landed", "opp_td_attempted")} | {f"{z}_def": (f"opp_{z}_landed", f"opp_{z}_attempted") for z in ("head", "body", "dist")}
BODY = ["height", "reach", "age"]
SIDE = [*FEATURES, *[f"{z}_acc" for z in ZONES], *[f"{z}_def" for z in ZONES], "sub_avg", "career_reversals", "slope_splm", "slope_td_acc", *EWMAS, *ADJUSTED, *BODY]
PAIR = ["grapple_ratio_diff", "striker_vs_wrestler", "wrestler_vs_striker", "southpaw_adv_diff", "both_southpaw", "rank_diff", "reach_class_diff", "splm_class_diff", "reach_ratio_diff", "age_ratio_diff", "td_matchup", "age_x_layoff_diff"]
#: Deviations within a class where it has none, and the least that count; least share of strikes that opponents let through.
REACH_STD, SPLM_STD, LEAST_ALLOWED = (6.5, 1.0), (2.0, 0.1), 0.05
#: Age and days since the last bout where they are not known.
AGE, IDLE = 30.0, 365.0


def long_wide(side_rows: DataFrame, bios: DataFrame, current: bool = False, as_of: Column | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Per side row the features of SIDE, and stance; bios(participant_id, height, reach, stance, dob).

    ``derived`` are columns of a side row that its other columns give.
    """
    c = F.col
    s = lambda x: w.prior_sum(x, current)
    met = with_defenses(side_rows, current, derived)
    rows = met.repartition("participant_id").withColumns(derived or {})
    rows = rows.withColumns({"_ewmas": w.ewmas([f(c) for f in EWMAS.values()], current=current), "_td": sc.accuracy(c("td_landed"), c("td_attempted")), "_pm": sc.per_minute(c("landed"), c("seconds"))})
    need = 2 if current else 5
    more = {f"{z}_acc": w.prior_ratio(c(f"{z}_landed"), c(f"{z}_attempted"), current=current) for z in ZONES}
    more |= {f"{z}_def": sc.defense_pct(s(c(f"opp_{z}_landed")), s(c(f"opp_{z}_attempted"))) for z in ZONES}
    more |= {"sub_avg": w.prior_mean(c("sub_att"), current), "career_reversals": s(c("reversals")), "slope_splm": w.slope(c("_pm"), 5, need, current), "slope_td_acc": w.slope(c("_td"), 5, need, current)}
    more |= {name: F.coalesce(F.get(c("_ewmas"), F.lit(i)), F.lit(0.0)) for i, name in enumerate(EWMAS)}
    more |= {f"_faced_{d}": F.avg(positive(c(f"_met_{d}"))).over(w.prior(current)) for d in DEFENSES}
    more["opponent_id"] = c("opponent_id")
    league = met.agg(*[F.avg(positive(c(f"_met_{d}"))).alias(f"_league_{d}") for d in DEFENSES])
    out = adjusted(long_features(rows, current, as_of, more), league)
    b = small(bios.select("participant_id", *[c(x).cast("double") for x in ("height", "reach")], F.lower(F.trim("stance")).alias("stance"), "dob"))
    at = c("date") if not current else F.coalesce(as_of, F.current_date()) if as_of is not None else F.current_date()
    return out.join(b, "participant_id", "left").withColumn("age", sc.age_years(at, c("dob"))).drop("dob")


def with_defenses(side_rows: DataFrame, current: bool = False, derived: dict[str, Column] | None = None) -> DataFrame:
    """Adds _met_<defense>: what the opponent's DEFENSES were in the bout. A participant has one row in a bout."""
    s = lambda x: w.prior_sum(F.col(x), current)
    own = side_rows.repartition("participant_id").withColumns(derived or {}).select("bout_id", "participant_id", *[sc.defense_pct(s(a), s(b)).alias(d) for d, (a, b) in DEFENSES.items()])
    # Both sides of a bout are one small array, so the rows themselves need not move if they lie by bout.
    both = own.repartition("bout_id").groupBy("bout_id").agg(F.collect_list(F.struct("participant_id", *DEFENSES)).alias("_both"))
    other = F.get(F.filter("_both", lambda x: x.participant_id == F.col("opponent_id")), F.lit(0))
    rows = side_rows.join(both, "bout_id", "left").withColumn("_met", other)
    return rows.select(*side_rows.columns, *[F.col(f"_met.{d}").alias(f"_met_{d}") for d in DEFENSES])


def adjusted(long: DataFrame, league: DataFrame) -> DataFrame:
    """Adds ADJUSTED: own * (share that the league lets through / share that the opponents so far let through)."""
    rows = long.crossJoin(F.broadcast(league))
    faced = {d: F.coalesce(F.col(f"_faced_{d}"), F.col(f"_league_{d}")) for d in DEFENSES}
    allowed = lambda x: 1 - x / 100
    new = {n: F.coalesce(F.col(own) * allowed(F.col(f"_league_{d}")) / F.greatest(allowed(faced[d]), F.lit(LEAST_ALLOWED)), F.lit(0.0)) for n, (own, d) in ADJUSTED.items()}
    return rows.withColumns(new).drop(*[f"_faced_{d}" for d in DEFENSES], *[f"_league_{d}" for d in DEFENSES])


def class_stds(long: DataFrame) -> DataFrame:
    """(class, reach_std, splm_std): sample deviations over all sides of a class with a value above 0."""
    return long.groupBy("class").agg(F.stddev_samp(positive(F.col("reach"))).alias("reach_std"), F.stddev_samp(positive(F.col("landed_pm"))).alias("splm_std"))


def pair_features() -> dict[str, Column]:
    """Of both sides' columns r_ and b_, the ranks, and the class's deviations."""
    r, b = (lambda x: F.coalesce(F.col(f"r_{x}"), F.lit(0.0))), (lambda x: F.coalesce(F.col(f"b_{x}"), F.lit(0.0)))
    strike = lambda f: f("landed_pm") / (f("landed_pm") + f("td_per_15") + 1e-6)
    grapple = lambda f: f("td_per_15") / (f("landed_pm") + f("td_per_15") + 1e-6)
    stance = lambda s: F.coalesce(F.col(f"{s}_stance"), F.lit("orthodox"))
    std = lambda c, other: F.greatest(F.coalesce(F.nanvl(F.col(c), F.lit(other[0])), F.lit(other[0])), F.lit(other[1]))
    known = lambda s, x, other: F.coalesce(F.col(f"{s}_{x}").cast("double"), F.lit(other))
    share = lambda f: F.least(F.greatest(f("td_def"), F.lit(0.0)), F.lit(100.0)) / 100
    return {
        "grapple_ratio_diff": grapple(r) - grapple(b), "striker_vs_wrestler": strike(r) * grapple(b), "wrestler_vs_striker": grapple(r) * strike(b),
        "southpaw_adv_diff": sc.stance_matchup(stance("r"), stance("b")), "both_southpaw": ((stance("r") == "southpaw") & (stance("b") == "southpaw")).cast("int"),
        "rank_diff": sc.rank_value(F.col("r_rank")) - sc.rank_value(F.col("b_rank")),
        "reach_class_diff": (r("reach") - b("reach")) / std("reach_std", REACH_STD), "splm_class_diff": (r("landed_pm") - b("landed_pm")) / std("splm_std", SPLM_STD),
        "reach_ratio_diff": sc.ratio_advantage(r("reach"), b("reach")), "age_ratio_diff": sc.ratio_advantage(known("r", "age", AGE), known("b", "age", AGE)),
        "td_matchup": r("td_per_15") * (1 - share(b)) - b("td_per_15") * (1 - share(r)),
        "age_x_layoff_diff": known("r", "age", AGE) * known("r", "idle", IDLE) - known("b", "age", AGE) * known("b", "idle", IDLE),
    }


def wide_matrix(bouts: DataFrame, side_rows: DataFrame, bios: DataFrame, classes: list[str], debuts: bool = False, derived: dict[str, Column] | None = None) -> DataFrame:
    """bout_id, ts, date, class, target, title, one column per class, <feature>_diff of SIDE, and PAIR, for decided bouts.

    bouts need r_rank and b_rank. Values that are not known count as 0 in differences.
    """
    long = long_wide(side_rows, bios, derived=derived)
    # Dealt before they are widened: half-empty r_ and b_ columns need not move.
    w2 = widen(long.repartition("bout_id"), ["bout_id"], [*SIDE, "stance"])
    b = bouts.select("bout_id", "ts", "date", "class", F.col("red_win").alias("target"), "title", "r_rank", "b_rank").where("target IS NOT NULL")
    # One row a class; dealt by class, the widest rows would lie in as many tasks as there are classes.
    out = b.join(w2, "bout_id").join(F.broadcast(class_stds(long)), "class", "left")
    if not debuts:
        out = out.where("r_bouts_before > 0 AND b_bouts_before > 0")
    zero = lambda s, f: F.coalesce(F.col(f"{s}_{f}").cast("double"), F.lit(0.0))
    diffs = [scrub(zero("r", f) - zero("b", f)).alias(f"{f}_diff") for f in SIDE]
    return out.select("bout_id", "ts", "date", "class", "target", "title", *sc.one_hot(F.col("class"), classes), *diffs, *[scrub(x).alias(n) for n, x in pair_features().items()])
