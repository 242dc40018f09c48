"""The wide matrix over the test tables: zones, ranks and biographies are made from the tables' own numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bouts as data
from . import wide
from .bouts import side_rows, table
from .catalog import PRIOR, TL, _features_sql, day, query, rd

#: Of a side's hits and control: what is left by division, for hits and for misses.
ZONE_MODS = {"head": (13, 6), "body": (7, 4), "leg": (5, 3), "dist": (17, 8), "clinch": (4, 5), "ground": (6, 7)}
CLASSES = ["click", "view", "signup"]


def zoned() -> dict[str, Column]:
    new = {}
    for o in ("", "opp_"):
        for z, (a, b) in ZONE_MODS.items():
            new |= {f"{o}{z}_landed": F.col(f"{o}landed") % a, f"{o}{z}_attempted": F.col(f"{o}landed") % a + F.col(f"{o}ctrl") % b}
    new |= {"reversals": (F.col("ctrl") % 4 == 0).cast("long"), "r1_landed": F.col("landed") % 9, "r1_ctrl": F.col("ctrl") % 20, "r1_reversals": (F.col("ctrl") % 8 == 0).cast("long")}
    new["r1_seconds"] = F.when(F.col("finish_round") > 1, 300).otherwise(F.col("seconds"))
    return new


def bios(spark, d):
    k = F.col("c_custkey")
    stance = F.when(k % 5 == 0, "Southpaw").when(k % 5 == 1, " Switch").when(k % 11 == 0, None).otherwise("Orthodox")
    return table(spark, d, "customer").select(k.alias("participant_id"), (160 + k % 40).alias("height"), F.when(k % 7 != 0, 160 + (k * 3) % 45).alias("reach"), stance.alias("stance"), F.date_add(F.to_date(F.lit("1980-01-01")), (k % 7000).cast("int")).alias("dob"))


def ranked(spark, d):
    rank = lambda s: F.when(F.col(f"{s}_ctrl") % 17 < 16, F.col(f"{s}_ctrl") % 17).alias(f"{s}_rank")
    return data.bouts(spark, d).select("*", rank("r"), rank("b"))


def _wide_sql() -> str:
    div = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
    acc = lambda z: f"CASE WHEN {z}_attempted = 0 THEN 0 ELSE {z}_landed / ({z}_attempted + 1e-6) END"
    zone = ", ".join(f"{o}landed % {a} AS {o}{z}_landed, {o}landed % {a} + {o}ctrl % {b} AS {o}{z}_attempted" for o in ("opp_",) for z, (a, b) in ZONE_MODS.items())
    bout = {
        "td_acc": acc("td"), "head_acc": acc("head"), "body_acc": acc("body"), "dist_acc": acc("dist"), "td_avg": div("td_landed * 900.0", "seconds"), "sapm": div("opp_landed * 60.0", "seconds"), "clinch_per": div("clinch_landed", "landed"),
        "sub_att": "sub_att", "kd_received": "opp_kd", "reversals": "CAST(ctrl % 4 = 0 AS INTEGER)", "ctrl_r1": div("(ctrl % 20)", "CASE WHEN finish_round > 1 THEN 300 ELSE seconds END"),
        "splm_r1": div("(landed % 9) * 60.0", "CASE WHEN finish_round > 1 THEN 300 ELSE seconds END"), "reversals_r1": "CAST(ctrl % 8 = 0 AS INTEGER)",
    }
    total = lambda x: f"coalesce(sum({x}) {PRIOR}, 0)"
    last5 = PRIOR.replace("UNBOUNDED PRECEDING", "5 PRECEDING")
    slope = lambda x: f"CASE WHEN count({x}) {last5} >= 5 THEN coalesce(regr_slope({x}, rn) {last5}, 0) ELSE 0 END"
    more = {f"{z}_acc": f"coalesce({total(f'{z}_landed')} / nullif({total(f'{z}_attempted')}, 0), 0)" for z in ZONE_MODS}
    more |= {f"{z}_def": f"coalesce(({total(f'opp_{z}_attempted')} - {total(f'opp_{z}_landed')}) * 100.0 / nullif({total(f'opp_{z}_attempted')}, 0), 0)" for z in ZONE_MODS}
    more |= {"sub_avg": f"coalesce(avg(sub_att) {PRIOR}, 0)", "career_reversals": total("e_reversals"), "slope_splm": slope("pm"), "slope_td_acc": slope("e_td_acc")}
    sums = ", ".join(f"coalesce(sum(b.e_{x} * pow(2.0 / 3, a.rn - b.rn)) / sum(pow(2.0 / 3, a.rn - b.rn)), 0) AS ewma_{x}" for x in bout)
    defenses = sorted({x for _, x in wide.ADJUSTED.values()})
    positive = lambda x: f"CASE WHEN {x} > 0 THEN {x} END"
    adj = ", ".join(f"coalesce({own} * (1 - (SELECT {x} FROM league) / 100) / greatest(1 - coalesce(avg({positive(f'o_{x}')}) {PRIOR}, (SELECT {x} FROM league)) / 100, 0.05), 0) AS {n}" for n, (own, x) in wide.ADJUSTED.items())
    strike, grapple = (lambda s: f"{s}.landed_pm / ({s}.landed_pm + {s}.td_per_15 + 1e-6)"), (lambda s: f"{s}.td_per_15 / ({s}.landed_pm + {s}.td_per_15 + 1e-6)")
    stance = lambda s: f"coalesce({s}.stance, 'orthodox')"
    rank = lambda s: f"CASE WHEN m.{s}_ctrl % 17 < 16 THEN m.{s}_ctrl % 17 ELSE 16 END"
    ratio = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN {a} / greatest({b}, 1.0) - 1 ELSE 0 END"
    pair = {
        "grapple_ratio_diff": f"{grapple('r')} - {grapple('l')}", "striker_vs_wrestler": f"{strike('r')} * {grapple('l')}", "wrestler_vs_striker": f"{grapple('r')} * {strike('l')}",
        "southpaw_adv_diff": f"CAST({stance('r')} = 'southpaw' AND {stance('l')} = 'orthodox' AS INTEGER) - CAST({stance('r')} = 'orthodox' AND {stance('l')} = 'southpaw' AS INTEGER)",
        "both_southpaw": f"CAST({stance('r')} = 'southpaw' AND {stance('l')} = 'southpaw' AS INTEGER)", "rank_diff": f"{rank('r')} - {rank('b')}",
        "reach_class_diff": "(coalesce(r.reach, 0) - coalesce(l.reach, 0)) / greatest(coalesce(reach_std, 6.5), 1.0)", "splm_class_diff": "(r.landed_pm - l.landed_pm) / greatest(coalesce(splm_std, 2.0), 0.1)",
        "reach_ratio_diff": ratio("coalesce(r.reach, 0)", "coalesce(l.reach, 0)"), "age_ratio_diff": ratio("r.age", "l.age"),
        "td_matchup": "r.td_per_15 * (1 - least(greatest(l.td_def, 0), 100) / 100) - l.td_per_15 * (1 - least(greatest(r.td_def, 0), 100) / 100)", "age_x_layoff_diff": "r.age * r.idle - l.age * l.idle",
    }
    side = [x for x in wide.SIDE if x not in wide.BODY]
    diffs = ", ".join([f"round(r.{f} - l.{f}, 6) + 0 AS {f}_diff" for f in side] + [f"round(coalesce(r.{c}, 0) - coalesce(l.{c}, 0), 6) + 0 AS {f}_diff" for f, c in (("height", "height"), ("reach", "reach"), ("age", "raw_age"))] + [f"round(CAST({x} AS DOUBLE), 6) + 0 AS {n}" for n, x in pair.items()])
    return _features_sql(False) + f""", e AS (SELECT *, {zone}, {', '.join(f'{x} AS e_{n}' for n, x in bout.items())} FROM (SELECT *, {', '.join(f'landed % {a} AS {z}_landed, landed % {a} + ctrl % {b} AS {z}_attempted' for z, (a, b) in ZONE_MODS.items())} FROM f)
        ), more AS (SELECT bout_id, side, opponent_id, rn, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in more.items())} FROM (SELECT * REPLACE (landed AS landed) FROM e)
        ), ew AS (SELECT a.bout_id, a.side, {sums} FROM e a LEFT JOIN e b ON a.participant_id = b.participant_id AND b.rn < a.rn GROUP BY 1, 2
        ), al AS (SELECT feats.*, more.* EXCLUDE (bout_id, side, rn), ew.* EXCLUDE (bout_id, side) FROM feats JOIN more USING (bout_id, side) JOIN ew USING (bout_id, side)
        ), op AS (SELECT a.*, {', '.join(f'b.{x} AS o_{x}' for x in defenses)} FROM al a LEFT JOIN al b ON a.bout_id = b.bout_id AND a.opponent_id = b.participant_id
        ), league AS (SELECT {', '.join(f"avg({positive(f'o_{x}')}) AS {x}" for x in defenses)} FROM op
        ), bio AS (SELECT c_custkey AS participant_id, CAST(160 + c_custkey % 40 AS DOUBLE) AS height, CAST(CASE WHEN c_custkey % 7 <> 0 THEN 160 + (c_custkey * 3) % 45 END AS DOUBLE) AS reach, CASE WHEN c_custkey % 5 = 0 THEN 'southpaw' WHEN c_custkey % 5 = 1 THEN 'switch' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'orthodox' END AS stance, DATE '1980-01-01' + CAST(c_custkey % 7000 AS INTEGER) AS dob FROM customer
        ), fin AS (SELECT op.*, height, reach, stance, CASE WHEN dob IS NULL THEN NULL ELSE date_diff('day', CAST(dob AS DATE), date) / 365.25 END AS raw_age, {adj} FROM op LEFT JOIN bio USING (participant_id)
        ), sd AS (SELECT class, stddev_samp(CASE WHEN reach > 0 THEN reach END) AS reach_std, stddev_samp(CASE WHEN landed_pm > 0 THEN landed_pm END) AS splm_std FROM fin GROUP BY class
        ), r AS (SELECT *, coalesce(raw_age, 30) AS age FROM fin WHERE side = 'r'), l AS (SELECT *, coalesce(raw_age, 30) AS age FROM fin WHERE side = 'b')
        SELECT bout_id, CAST(m.date AS VARCHAR) AS date, m.class, red_win AS target, m.title, {', '.join(f"CAST(lower(m.class) = '{c}' AS INTEGER) AS class_{c}" for c in CLASSES)}, {diffs}
        FROM bouts m JOIN r USING (bout_id) JOIN l USING (bout_id) LEFT JOIN sd ON sd.class = m.class WHERE red_win IS NOT NULL AND r.bouts_before > 0 AND l.bouts_before > 0"""


@query("q_wide_matrix", _wide_sql())
def _(spark, d):
    m = wide.wide_matrix(ranked(spark, d), side_rows(spark, d), bios(spark, d), CLASSES, derived=zoned())
    return m.select("bout_id", day("date").alias("date"), "class", "target", "title", *[f"class_{c}" for c in CLASSES], *[rd(f"{f}_diff", 6).alias(f"{f}_diff") for f in wide.SIDE], *[rd(F.col(n).cast("double"), 6).alias(n) for n in wide.PAIR])
