"""Named queries over the test tables, each with the oracle's SQL where SQL can state it.

Results are rounded to nine places on both sides, counts are 64-bit, and every order has a tie-break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safe, scalar, text
from ..operators import aggregates as ag
from ..operators import dml, evaluate, joins, longform, models, ratings
from ..operators import windows as w
from ..operators.donors import exact_quantile
from ..session import written
from ..sources import html, schema, sinks
from ..streaming import ingest
from . import bouts as data
from . import features, serve
from .bouts import BOUTS_SQL, SIDES_SQL, side_rows, table
from .streams import stream_career, stream_counts, stream_ingest, stream_sessions, stream_unique

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rd(x: Column | str, digits: int = 9) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def day(x: Column | str) -> Column:
    """Days and times are compared as text."""
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def n64(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


PRIOR = "OVER (PARTITION BY participant_id ORDER BY ts, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
TL = "OVER (PARTITION BY participant_id ORDER BY ts, bout_id)"
LAST = lambda n: f"OVER (PARTITION BY participant_id ORDER BY ts, bout_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
SCORED_SQL = BOUTS_SQL + """scored AS (
    SELECT *, red_win AS y, round((r_ctrl + 1.0) / (r_ctrl + b_ctrl + 2.0), 9) AS p_red,
           CAST(CAST(round((r_ctrl + 1.0) / (r_ctrl + b_ctrl + 2.0), 9) >= 0.5 AS INTEGER) = red_win AS INTEGER) AS correct
    FROM bouts WHERE red_win IS NOT NULL
) """


def scored(spark, d) -> DataFrame:
    """Decided bouts with a stand-in probability."""
    p = F.round((F.col("r_ctrl") + 1.0) / (F.col("r_ctrl") + F.col("b_ctrl") + 2.0), 9)
    b = data.bouts(spark, d).where("red_win IS NOT NULL").withColumns({"y": F.col("red_win"), "p_red": p})
    return b.withColumn("correct", ((F.col("p_red") >= 0.5).cast("int") == F.col("y")).cast("int"))


# Scans, filters, points.
@query("q_scan_project", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_returnflag = 'N'")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP'1998-06-01' AND l_returnflag = 'N'").select("l_orderkey", "l_partkey", "l_quantity")


@query("q_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(spark, d):
    return schema.point(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("q_filter_decided", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, CAST(date AS VARCHAR) AS date, class, red_win FROM bouts WHERE red_win IS NOT NULL AND date >= DATE '2024-01-05'")
def _(spark, d):
    return data.bouts(spark, d).where("red_win IS NOT NULL AND date >= DATE'2024-01-05'").select("bout_id", day("date").alias("date"), "class", "red_win")


@query("q_either_side", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side, opponent_id FROM sides WHERE participant_id = 7")
def _(spark, d):
    return side_rows(spark, d).where("participant_id = 7").select("bout_id", "side", "opponent_id")


@query("q_in_set", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side, participant_id FROM sides WHERE participant_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    return joins.exists(side_rows(spark, d), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("participant_id")), ["participant_id"]).select("bout_id", "side", "participant_id")


# Text.
@query("q_ids_md5", "SELECT c_custkey, substr(md5(lower(trim(c_name))), 1, 16) AS participant_id, trim(regexp_replace(lower(c_name), '[^a-z ]', '', 'g')) AS name_key FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.participant_id(F.col("c_name")).alias("participant_id"), text.name_key(F.col("c_name")).alias("name_key"))


@query("q_bout_id", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(md5(l_partkey || '|' || l_suppkey || '|' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR)), 1, 16) AS bout_id FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.bout_id(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate").cast("date")).alias("bout_id"))


@query("q_url_tail", "SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS tail, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_tail(F.col("url")).alias("tail"), text.slug(F.col("url")).alias("slug"))


@query("q_strip_ws", "SELECT doc_id, md5(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')) AS h FROM documents WHERE lang = 'en'")
def _(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.md5(text.strip_ws(F.col("text")).cast("binary")).alias("h"))


@query("q_parse_of", "SELECT event_id, CAST(floor(value) AS INTEGER) AS landed, CAST(floor(value) AS INTEGER) + CAST(json_extract_string(props, '$.k') AS INTEGER) AS attempted FROM events")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.floor("value").cast("int")
    x = text.x_of_y(F.concat(F.lit("  "), v.cast("string"), F.lit(" of "), (v + k).cast("string"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", x.landed.alias("landed"), x.attempted.alias("attempted"))


@query("q_clock_seconds", "SELECT event_id, CAST(k AS INTEGER) AS seconds, CAST((greatest(k % 4, 1) - 1) * 300 + k AS INTEGER) AS elapsed FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    clock = F.concat(F.floor(k / 60).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    return table(spark, d, "events").select("event_id", text.clock_seconds(clock).alias("seconds"), text.elapsed_seconds(k % 4, clock).alias("elapsed"))


@query("q_month_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d1, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d2 FROM orders")
def _(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", day(text.month_date(F.date_format(t, "MMM. dd, yyyy"))).alias("d1"), day(text.ordinal_date(F.concat(F.date_format(t, "MMMM d"), F.lit("th")), F.year(t))).alias("d2"))


@query("q_norm_method", "SELECT event_id, CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'KO/TKO' WHEN 1 THEN 'Submission' WHEN 2 THEN 'Decision - Unanimous' ELSE 'Decision - Split' END AS method, CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS finish, CASE WHEN event_id % 2 = 0 THEN 'light heavyweight' ELSE 'heavyweight' END AS class FROM events")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    raw = F.when(k == 0, "tko (punches)").when(k == 1, "SUB - choke").when(k == 2, "Unanimous dec").otherwise("split DECISION")
    m = text.method_of(raw)
    return table(spark, d, "events").select("event_id", m.alias("method"), text.finish_class(m).alias("finish"), text.class_of(F.when(F.col("event_id") % 2 == 0, "Light Heavyweight Bout").otherwise("Heavyweight Title Bout")).alias("class"))


@query("q_body_measures", "SELECT p_partkey, round(CAST(p_size * 2.54 AS DOUBLE), 1) AS reach, round(CAST((60 + p_size % 12) * 2.54 AS DOUBLE), 1) AS height FROM part")
def _(spark, d):
    s = F.col("p_size")
    r = lambda x: F.round(x.cast("double"), 1)
    return table(spark, d, "part").select("p_partkey", r(text.reach_cm(F.concat(s.cast("string"), F.lit('"')))).alias("reach"), r(text.height_cm(F.concat(F.lit("5' "), (s % 12).cast("string"), F.lit('"')))).alias("height"))


@query("q_search", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%00001%' ORDER BY c_name LIMIT 20")
def _(spark, d):
    return serve.search(table(spark, d, "customer"), "00001", "c_name").select("c_custkey", "c_name")


@query("q_parse_loose", """
    SELECT event_id, CAST(floor(value) AS INTEGER) AS landed, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS INTEGER) AS kind,
           CAST(CAST(ts AS DATE) AS VARCHAR) AS d1, CAST(CAST(ts AS DATE) AS VARCHAR) AS d2,
           CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'Decision - Unanimous' WHEN 1 THEN 'Decision - Split' WHEN 2 THEN 'Decision - Majority' ELSE 'Decision - Unanimous' END AS method,
           round(CAST((event_id % 90) * 2.54 AS DOUBLE), 1) AS reach, CAST(NULL AS DOUBLE) AS height, CAST((event_id % 5) * 300 + event_id % 60 AS INTEGER) AS elapsed, 0 AS unread
    FROM events""")
def _(spark, d):
    """The forms that sources write beside the usual ones: percentages, no comma, codes, no inch mark, no inches, words after a clock."""
    e, k, v, i = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int") % 4, F.floor("value").cast("int").cast("string"), F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, ("U-DEC", "S-DEC", "M-DEC", "dec"))), k + 1)
    clock = F.concat(F.lit("0:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(" left"))
    return e.select(
        "event_id", text.x_of_y(F.concat(v, F.lit(" of 9 (50%)"))).landed.alias("landed"), k.alias("kind"),
        day(text.month_date(F.date_format("ts", "MMM d yyyy"))).alias("d1"), day(text.month_date(F.date_format("ts", "MMMM. d, yyyy 'GMT'"))).alias("d2"), text.method_of(code).alias("method"),
        F.round(text.reach_cm((i % 90).cast("string")), 1).alias("reach"), text.height_cm(F.lit("6'")).alias("height"),
        text.elapsed_seconds((i % 5 + 1).cast("int"), clock).alias("elapsed"), text.elapsed_seconds(F.lit(3), F.lit("--")).alias("unread"),
    )


# Dates.
@query("q_age_quarter", "SELECT o_orderkey, round(date_diff('day', DATE '1980-02-29', CAST(o_orderdate AS DATE)) / 365.25, 9) AS age, CAST(date_diff('day', DATE '1980-02-29', CAST(o_orderdate AS DATE)) // 365 AS INTEGER) AS age_whole, CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter FROM orders")
def _(spark, d):
    born = F.to_date(F.lit("1980-02-29"))
    t = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", rd(scalar.age_years(t, born)).alias("age"), scalar.age_whole(t, born).alias("age_whole"), day(scalar.quarter_of(t)).alias("quarter"))


@query("q_day_window", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 1 AND a.o_orderkey < b.o_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    pairs = joins.within_days(o.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("day").alias("day_a")), o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("day").alias("day_b")), ["o_custkey"], "day_a", "day_b")
    return pairs.where("a < b").select("a", "b")


@query("q_sample_weight", "SELECT o_orderkey, round(exp(-0.3 * pow(my - year(o_orderdate), 1.2)), 9) AS weight FROM orders, (SELECT max(year(o_orderdate)) AS my FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders")
    newest = o.agg(F.max(F.year("o_orderdate")).alias("my"))
    return o.crossJoin(F.broadcast(newest)).select("o_orderkey", rd(scalar.sample_weight(F.year("o_orderdate"), F.col("my"), 0.3, 1.2)).alias("weight"))


# Rates, pairs, odds.
@query("q_rates_safe", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side, round(CASE WHEN attempted = 0 THEN 0 ELSE landed / (attempted + 1e-6) END, 9) AS acc, round(coalesce(landed * 60.0 / nullif(seconds, 0), 0), 9) AS pm, round(coalesce((opp_attempted - opp_landed) * 100.0 / nullif(opp_attempted, 0), 0), 9) AS def, CAST(greatest(ceil(seconds / 300.0), 1) AS INTEGER) AS rounds FROM sides")
def _(spark, d):
    s = F.col
    return side_rows(spark, d).select("bout_id", "side", rd(scalar.accuracy(s("landed"), s("attempted"))).alias("acc"), rd(scalar.per_minute(s("landed"), s("seconds"))).alias("pm"), rd(scalar.defense_pct(s("opp_landed"), s("opp_attempted"))).alias("def"), scalar.rounds_fought(s("seconds")).alias("rounds"))


@query("q_onehot", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, CAST(class = 'click' AS INTEGER) AS class_click, CAST(class = 'view' AS INTEGER) AS class_view, CAST(class = 'signup' AS INTEGER) AS class_signup FROM bouts")
def _(spark, d):
    return data.bouts(spark, d).select("bout_id", *scalar.one_hot(F.col("class"), ["click", "view", "signup"]))


@query("q_pair_features", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, round(CASE WHEN r_ctrl > 0 AND b_ctrl > 0 THEN r_ctrl / greatest(b_ctrl, 1.0) - 1 ELSE 0 END, 9) AS ratio, round((r_landed - b_landed) / greatest(10.0, 5.0), 9) AS scaled, round(least(greatest(r_ctrl * (100 - b_ctrl) / 100.0, 0), 100), 9) AS matchup, CAST(r_landed - b_landed AS BIGINT) AS landed_diff FROM bouts")
def _(spark, d):
    s = F.col
    return data.bouts(spark, d).select("bout_id", rd(scalar.ratio_advantage(s("r_ctrl"), s("b_ctrl"))).alias("ratio"), rd(scalar.scaled_diff(s("r_landed"), s("b_landed"), F.lit(10.0), 5.0)).alias("scaled"), rd(scalar.takedown_matchup(s("r_ctrl"), s("b_ctrl"))).alias("matchup"), *scalar.differences(["landed"]))


@query("q_odds", SCORED_SQL + """, o AS (
    SELECT bout_id, p_red, CASE WHEN odds_red < 0 THEN -odds_red / (100 - odds_red) ELSE 100 / (odds_red + 100) END AS ir, CASE WHEN odds_blue < 0 THEN -odds_blue / (100 - odds_blue) ELSE 100 / (odds_blue + 100) END AS ib,
           CASE WHEN odds_red < 0 THEN 1 + 100 / -odds_red ELSE 1 + odds_red / 100 END AS dr FROM scored)
    SELECT bout_id, round(ir, 9) AS implied_red, round(ib, 9) AS implied_blue, round(ir / (ir + ib), 9) AS fair_red, round(p_red - ir, 9) AS edge,
           round(CASE WHEN p_red - ir <= 0 OR dr <= 1 THEN 0 ELSE greatest(0, 0.25 * ((dr - 1) * (p_red - ir + 1 / dr) - (1 - (p_red - ir + 1 / dr))) / (dr - 1)) END, 9) + 0 AS stake FROM o""")
def _(spark, d):
    p = serve.priced(scored(spark, d).select("bout_id", "p_red", "odds_red", "odds_blue"))
    return p.select("bout_id", rd("implied_red").alias("implied_red"), rd("implied_blue").alias("implied_blue"), rd("fair_red").alias("fair_red"), rd("edge_red").alias("edge"), rd("stake_red").alias("stake"))


# Shapes and joins.
@query("q_unpivot_sides", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side, participant_id, opponent_id, landed, opp_landed, CAST(is_win AS INTEGER) AS is_win FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", "participant_id", "opponent_id", "landed", "opp_landed", "is_win")


@query("q_corner_widen", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, r_id AS r_participant_id, b_id AS b_participant_id, r_landed, b_landed, r_kd, b_kd FROM bouts")
def _(spark, d):
    return longform.widen(side_rows(spark, d), ["bout_id"], ["landed", "kd"])


@query("q_opponent_rows", SIDES_SQL + "x AS (SELECT 1) SELECT a.bout_id, a.participant_id, b.landed AS opp_value, b.ctrl AS opp_ctrl2 FROM sides a JOIN sides b ON a.bout_id = b.bout_id AND a.participant_id <> b.participant_id")
def _(spark, d):
    s = side_rows(spark, d).select("bout_id", "participant_id", "opponent_id", F.col("landed").alias("value"), F.col("ctrl").alias("ctrl2"))
    return longform.opponent_rows(s, ["value", "ctrl2"]).select("bout_id", "participant_id", "opp_value", "opp_ctrl2")


@query("q_latest_per_key", SIDES_SQL + "x AS (SELECT 1) SELECT participant_id, bout_id, landed FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY ts DESC, bout_id DESC) AS n FROM sides) WHERE n = 1")
def _(spark, d):
    return joins.latest_per_key(side_rows(spark, d).select("participant_id", "ts", "bout_id", "landed"), ["participant_id"], ["ts", "bout_id"]).select("participant_id", "bout_id", "landed")


@query("q_h2h_pair", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, CAST(date AS VARCHAR) AS date, r_id, b_id, winner_id FROM bouts WHERE least(r_id, b_id) = 7 AND greatest(r_id, b_id) = 12")
def _(spark, d):
    return serve.meetings(data.bouts(spark, d), 12, 7).select("bout_id", day("date").alias("date"), "r_id", "b_id", "winner_id")


@query("q_asof_signup", "SELECT p.event_id, coalesce(s.event_id, -1) AS signup_id, coalesce(s.value, -1) AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts")
def _(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value"))
    return joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "ts", ["signup_id", "signup_value"]).na.fill(-1).select("event_id", "signup_id", "signup_value")


@query("q_asof_two_key", "SELECT p.event_id, coalesce(s.event_id, -1) AS rank_id FROM (SELECT *, event_id % 2 AS g FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT *, event_id % 2 AS g FROM events WHERE event_type = 'view') s ON p.user_id = s.user_id AND p.g = s.g AND p.ts >= s.ts")
def _(spark, d):
    e = table(spark, d, "events").withColumn("g", F.col("event_id") % 2)
    right = e.where("event_type = 'view'").select("user_id", "g", F.col("ts").alias("at"), F.col("event_id").alias("rank_id"))
    return joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "g", "ts"), right, ["user_id", "g"], "ts", "at", ["rank_id"]).na.fill(-1).select("event_id", "rank_id")


@query("q_pair_odds", BOUTS_SQL + "q AS (SELECT least(r_id, b_id) AS a, greatest(r_id, b_id) AS b, max(odds_red) AS oa, max(odds_blue) AS ob FROM bouts GROUP BY 1, 2) SELECT bout_id, CASE WHEN r_id = a THEN oa ELSE ob END AS red_odds, CASE WHEN r_id = a THEN ob ELSE oa END AS blue_odds FROM bouts JOIN q ON least(r_id, b_id) = a AND greatest(r_id, b_id) = b")
def _(spark, d):
    b = data.bouts(spark, d)
    odds = b.groupBy(F.least("r_id", "b_id").alias("a"), F.greatest("r_id", "b_id").alias("b")).agg(F.max("odds_red").alias("odds_a"), F.max("odds_blue").alias("odds_b"))
    return joins.pair_lookup(b.select("bout_id", "r_id", "b_id"), odds, "r_id", "b_id").select("bout_id", F.col("odds_a").alias("red_odds"), F.col("odds_b").alias("blue_odds"))


@query("q_names", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, r.c_name AS r_name, b.c_name AS b_name FROM bouts LEFT JOIN customer r ON r_id = r.c_custkey LEFT JOIN customer b ON b_id = b.c_custkey")
def _(spark, d):
    return joins.names_of(data.bouts(spark, d).select("bout_id", "r_id", "b_id"), table(spark, d, "customer"), {"r_id": "r_name", "b_id": "b_name"}, "c_custkey", "c_name").select("bout_id", "r_name", "b_name")


@query("q_alias", "SELECT n_nationkey, CASE n_name WHEN (SELECT min(n_name) FROM nation) THEN 'first' ELSE n_name END AS n_name FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return joins.with_alias(n.select("n_nationkey", "n_name"), "n_name", n.agg(F.min("n_name").alias("alias")).withColumn("name", F.lit("first")))


@query("q_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def _(spark, d):
    parent = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return dml.foreign_key_violations(table(spark, d, "lineitem"), parent, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("q_semi_history", SIDES_SQL + "x AS (SELECT 1) SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM sides WHERE participant_id = c_custkey)")
def _(spark, d):
    return joins.exists(table(spark, d, "customer"), side_rows(spark, d).select(F.col("participant_id").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("q_pending_anti", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id FROM bouts WHERE bout_id NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    return ingest.pending(data.bouts(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bout_id"))).select("bout_id")


@query("q_first_rows", SIDES_SQL + "x AS (SELECT 1) SELECT participant_id, bout_id FROM sides s WHERE date = (SELECT min(date) FROM sides t WHERE t.participant_id = s.participant_id)")
def _(spark, d):
    return joins.first_rows(side_rows(spark, d)).select("participant_id", "bout_id")


@query("q_affected", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side FROM sides WHERE bout_id IN (SELECT bout_id FROM sides WHERE participant_id IN (3, 5))")
def _(spark, d):
    return ingest.affected(side_rows(spark, d), spark.createDataFrame([(3,), (5,)], "participant_id long")).select("bout_id", "side")


@query("q_fuzzy_pairs")
def _(spark, d):
    n = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    left = n.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.lower("s_name").alias("a"), F.col("s_name").alias("b"))
    right = n.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("rid"), F.col("s_name").alias("a"), F.lower("s_name").alias("b"))
    return joins.fuzzy_pairs(left, right, ["g"], 0.85)


@query("q_best_match")
def _(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", F.lower("s_name").alias("a"), F.col("s_name").alias("b"))
    return joins.best_match(n.withColumnRenamed("s_suppkey", "id"), n.withColumnRenamed("s_suppkey", "rid"), ["g"])


@query("q_closest")
def _(spark, d):
    s = table(spark, d, "supplier")
    return joins.closest(s.select(F.concat(F.lower("s_name"), F.lit("x")).alias("name")), s.select(F.lower("s_name").alias("candidate")), F.substring("name", -4, 3), F.substring("candidate", -3, 3), 0.8)


# Sets.
@query("q_symmetric_union", BOUTS_SQL + "m AS (SELECT bout_id, red_win AS target, CAST(r_landed - b_landed AS BIGINT) AS landed_diff FROM bouts WHERE red_win IS NOT NULL) SELECT * FROM m UNION ALL SELECT bout_id, 1 - target, -landed_diff FROM m")
def _(spark, d):
    m = data.bouts(spark, d).where("red_win IS NOT NULL").select("bout_id", F.col("red_win").alias("target"), *scalar.differences(["landed"]))
    return longform.mirrored(m)


@query("q_set_ops", BOUTS_SQL + "x AS (SELECT 1) (SELECT 'both' AS part, id FROM (SELECT r_id AS id FROM bouts WHERE class = 'click' INTERSECT SELECT b_id FROM bouts WHERE class = 'click')) UNION ALL (SELECT 'idle', id FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT r_id FROM bouts))")
def _(spark, d):
    b = data.bouts(spark, d)
    clicks = b.where("class = 'click'")
    both = clicks.select(F.col("r_id").alias("id")).intersect(clicks.select("b_id"))
    idle = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(b.select("r_id"))
    return both.select(F.lit("both").alias("part"), "id").unionByName(idle.select(F.lit("idle").alias("part"), "id"))


@query("q_align", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, r_landed, 0.0::DOUBLE AS absent FROM bouts")
def _(spark, d):
    return longform.aligned(data.bouts(spark, d), ["bout_id", "r_landed", "absent"])


# Aggregates.
@query("q_record", SIDES_SQL + "x AS (SELECT 1) SELECT participant_id, CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(is_loss) AS BIGINT) AS losses, CAST(sum(1 - is_win - is_loss) AS BIGINT) AS draws, count(*) AS bouts FROM sides GROUP BY 1")
def _(spark, d):
    return ag.record(side_rows(spark, d))


@query("q_method_rates", SIDES_SQL + "x AS (SELECT 1) SELECT participant_id, round(coalesce(sum(is_win * CAST(method = 'KO/TKO' AS INTEGER)) / nullif(sum(is_win), 0), 0), 9) AS ko_rate, round(coalesce(sum(is_win * CAST(method = 'Submission' AS INTEGER)) / nullif(sum(is_win), 0), 0), 9) AS sub_rate, round(coalesce(sum(is_win * CAST(method LIKE 'Decision%' AS INTEGER)) / nullif(sum(is_win), 0), 0), 9) AS dec_rate FROM sides GROUP BY 1")
def _(spark, d):
    return ag.method_rates(side_rows(spark, d)).select("participant_id", *[rd(x).alias(x) for x in ("ko_rate", "sub_rate", "dec_rate")])


@query("q_career_totals", SIDES_SQL + "x AS (SELECT 1) SELECT participant_id, CAST(sum(landed) AS BIGINT) AS landed, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(seconds) AS BIGINT) AS seconds, round(avg(landed), 9) AS avg_landed, round(coalesce(sum(landed) / nullif(sum(attempted), 0), 0), 9) AS accuracy FROM sides GROUP BY 1")
def _(spark, d):
    return ag.career_totals(side_rows(spark, d), ["landed", "attempted", "seconds"]).select("participant_id", "landed", "attempted", "seconds", rd("avg_landed").alias("avg_landed"), rd("accuracy").alias("accuracy"))


@query("q_year_report_rollup", SCORED_SQL + "SELECT coalesce(month(date), -1) AS month, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct, round(avg(correct), 9) AS accuracy FROM scored GROUP BY ROLLUP (month(date))")
def _(spark, d):
    return ag.report(scored(spark, d).withColumn("month", F.month("date").cast("long")), "month").select(F.coalesce("month", F.lit(-1)).alias("month"), "n", "n_correct", rd("accuracy").alias("accuracy"))


@query("q_class_report_having", SCORED_SQL + "SELECT class, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct, round(avg(correct), 9) AS accuracy FROM scored GROUP BY class HAVING count(*) >= 30")
def _(spark, d):
    return ag.report_having(scored(spark, d), "class").select("class", "n", "n_correct", rd("accuracy").alias("accuracy"))


@query("q_brier_report", SCORED_SQL + "SELECT count(*) AS n, round(avg(pow(p_red - y, 2)), 9) AS brier, round(avg(correct), 9) AS accuracy, round(avg(greatest(p_red, 1 - p_red)), 9) AS mean_confidence, round(greatest(avg(y), 1 - avg(y)), 9) AS naive FROM scored")
def _(spark, d):
    return ag.brier_report(scored(spark, d)).select("n", *[rd(x).alias(x) for x in ("brier", "accuracy", "mean_confidence", "naive")])


@query("q_calibration_bins", SCORED_SQL + "SELECT CAST(least(floor(p_red * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p_red), 9) AS mean_p, round(avg(y), 9) AS share FROM scored GROUP BY 1")
def _(spark, d):
    return ag.calibration(scored(spark, d)).select("bin", "n", rd("mean_p").alias("mean_p"), rd("share").alias("share"))


@query("q_confusion", SCORED_SQL + "SELECT y AS actual, CAST(p_red >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def _(spark, d):
    return ag.confusion(scored(spark, d))


@query("q_auc", SCORED_SQL + ", g AS (SELECT p_red, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p_red ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM r")
def _(spark, d):
    return ag.auc(scored(spark, d)).select(rd("auc").alias("auc"))


BETS_SQL = SCORED_SQL + """, e AS (
    SELECT *, p_red - CASE WHEN odds_red < 0 THEN -odds_red / (100 - odds_red) ELSE 100 / (odds_red + 100) END AS er, 1 - p_red - CASE WHEN odds_blue < 0 THEN -odds_blue / (100 - odds_blue) ELSE 100 / (odds_blue + 100) END AS eb,
           CASE WHEN odds_red < 0 THEN 1 + 100 / -odds_red ELSE 1 + odds_red / 100 END AS dr, CASE WHEN odds_blue < 0 THEN 1 + 100 / -odds_blue ELSE 1 + odds_blue / 100 END AS db FROM scored
), b AS (
    SELECT *, CASE WHEN er >= 0.05 AND (eb < 0.05 OR er >= eb) THEN 'red' WHEN eb >= 0.05 THEN 'blue' END AS bet FROM e
), f AS (
    SELECT *, CASE WHEN bet = 'red' THEN er ELSE eb END AS edge, CASE WHEN bet = 'red' THEN dr ELSE db END AS dec, CASE WHEN bet = 'red' THEN y ELSE 1 - y END AS won FROM b WHERE bet IS NOT NULL
), g AS (
    SELECT *, CASE WHEN won = 1 THEN dec - 1 ELSE -1 END AS profit, CASE WHEN edge <= 0 OR dec <= 1 THEN 0 ELSE greatest(0, 0.25 * ((dec - 1) * (edge + 1 / dec) - (1 - edge - 1 / dec)) / (dec - 1)) END AS stake FROM f
) """
BET_COLUMNS_SQL = "count(*) AS n_bets, round(avg(won), 9) AS win_rate, round(avg(profit), 9) AS flat_roi, round(coalesce(sum(stake * profit) / nullif(sum(stake), 0), 0), 9) AS kelly_roi, round(avg(edge), 9) AS avg_edge, round(avg(dec), 9) AS avg_odds"
BET_COLUMNS = ("win_rate", "flat_roi", "kelly_roi", "avg_edge", "avg_odds")


@query("q_bet_backtest", BETS_SQL + f"SELECT {BET_COLUMNS_SQL} FROM g")
def _(spark, d):
    return ag.bet_report(ag.bets(scored(spark, d))).select("n_bets", *[rd(x).alias(x) for x in BET_COLUMNS])


@query("q_bets_by_class", BETS_SQL + f"SELECT class, {BET_COLUMNS_SQL} FROM g GROUP BY class")
def _(spark, d):
    return ag.bet_report(ag.bets(scored(spark, d)), "class").select("class", "n_bets", *[rd(x).alias(x) for x in BET_COLUMNS])


@query("q_event_score", SCORED_SQL + """SELECT count(*) AS n, count(*) FILTER (correct = 1) AS n_correct, count(*) FILTER (y IS NULL) AS n_excluded, count(*) FILTER (greatest(p_red, 1 - p_red) >= 0.65) AS n_high,
    count(*) FILTER (greatest(p_red, 1 - p_red) >= 0.65 AND correct = 1) AS n_high_correct, count(*) FILTER (greatest(p_red, 1 - p_red) >= 0.55) AS n_staked,
    round(sum(CASE WHEN greatest(p_red, 1 - p_red) >= 0.55 THEN CASE WHEN correct = 1 THEN CASE WHEN o < 0 THEN 100 / -o ELSE o / 100 END ELSE -1 END END), 9) AS net FROM (SELECT *, CASE WHEN p_red >= 0.5 THEN odds_red ELSE odds_blue END AS o FROM scored)""")
def _(spark, d):
    return ag.event_score(scored(spark, d)).withColumn("net", rd("net"))


@query("q_group_shrink", SIDES_SQL + "p AS (SELECT class, participant_id, avg(landed) AS v, count(*) AS n FROM sides GROUP BY 1, 2) SELECT class, participant_id, round((n * v + 5 * avg(v) OVER (PARTITION BY class)) / (n + 5), 9) AS v_shrunk FROM p")
def _(spark, d):
    p = side_rows(spark, d).groupBy("class", "participant_id").agg(F.avg("landed").alias("v"), F.count("*").alias("n"))
    return ag.shrink(p, "v", "n", "class").select("class", "participant_id", rd("v_shrunk").alias("v_shrunk"))


@query("q_group_std", SIDES_SQL + "x AS (SELECT 1) SELECT class, round(stddev_samp(CASE WHEN ctrl > 0 THEN ctrl END), 9) AS ctrl_std, count(CASE WHEN ctrl > 0 THEN 1 END) AS n FROM sides GROUP BY class")
def _(spark, d):
    return ag.group_std(side_rows(spark, d), "ctrl", "class").select("class", rd("ctrl_std").alias("ctrl_std"), "n")


@query("q_global_median", SIDES_SQL + "x AS (SELECT 1) SELECT CAST(median(seconds) AS DOUBLE) AS median_seconds, round(avg(CASE WHEN kd > 0 THEN kd END), 9) AS kd FROM sides")
def _(spark, d):
    s = side_rows(spark, d)
    return s.agg(F.lit(exact_quantile(s, "seconds", 0.5)).alias("median_seconds"), rd(F.avg(safe.positive(F.col("kd")))).alias("kd"))


@query("q_league_mean", SIDES_SQL + "x AS (SELECT 1) SELECT round(avg(CASE WHEN landed > 0 THEN landed END), 9) AS landed, round(avg(CASE WHEN ctrl > 0 THEN ctrl END), 9) AS ctrl FROM sides")
def _(spark, d):
    return ag.league_means(side_rows(spark, d), ["landed", "ctrl"]).select(rd("landed").alias("landed"), rd("ctrl").alias("ctrl"))


@query("q_impute_debut", SIDES_SQL + "p AS (SELECT participant_id, class, CAST(sum(seconds) AS BIGINT) * CAST(participant_id % 3 > 0 AS INTEGER) AS seen, avg(landed) AS v FROM sides GROUP BY 1, 2) SELECT participant_id, class, round(CASE WHEN seen > 0 THEN v ELSE coalesce((SELECT avg(v) FROM p q WHERE q.class = p.class AND q.seen > 0), (SELECT avg(v) FROM p q WHERE q.seen > 0)) END, 9) AS v FROM p")
def _(spark, d):
    p = side_rows(spark, d).groupBy("participant_id", "class").agg((F.sum("seconds") * (F.col("participant_id") % 3 > 0).cast("int")).alias("seen"), F.avg("landed").alias("v"))
    return ag.impute_debut(p, "v", "seen", "class").select("participant_id", "class", rd("v").alias("v"))


@query("q_dedupe_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    return ag.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("q_integrity", SIDES_SQL + """x AS (SELECT 1) SELECT 'sides_not_two' AS "check", count(*) AS n FROM (SELECT bout_id FROM sides GROUP BY 1 HAVING count(*) <> 2) UNION ALL SELECT 'orphan_sides', count(*) FROM sides WHERE bout_id NOT IN (SELECT bout_id FROM bouts) UNION ALL SELECT 'repeated_bouts', count(*) FROM (SELECT bout_id FROM bouts GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'null_dates', count(*) FROM bouts WHERE date IS NULL UNION ALL SELECT 'foreign_winners', count(*) FROM bouts WHERE winner_id <> r_id AND winner_id <> b_id""")
def _(spark, d):
    return ag.violations(data.bouts(spark, d), side_rows(spark, d))


@query("q_distinct_count", SIDES_SQL + "x AS (SELECT 1) SELECT count(DISTINCT participant_id) AS participants, count(DISTINCT class) AS classes, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM sides")
def _(spark, d):
    return side_rows(spark, d).agg(F.count_distinct("participant_id").alias("participants"), F.count_distinct("class").alias("classes"), day(F.min("date")).alias("first_date"), day(F.max("date")).alias("last_date"))


@query("q_rounds_to_bouts", "SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))


# Windows.
@query("q_prior_wins", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, CAST(coalesce(sum(is_win) {PRIOR}, 0) AS BIGINT) AS wins, CAST(coalesce(sum(is_loss) {PRIOR}, 0) AS BIGINT) AS losses, row_number() {TL} - 1 AS bouts_before FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", w.prior_sum(F.col("is_win")).alias("wins"), w.prior_sum(F.col("is_loss")).alias("losses"), n64(w.bouts_before()).alias("bouts_before"))


@query("q_prior_sums", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side, " + ", ".join(f"CAST(coalesce(sum({s}) {PRIOR}, 0) AS BIGINT) AS {s}_before" for s in data.STATS) + " FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", *[w.prior_sum(F.col(s)).alias(f"{s}_before") for s in data.STATS])


@query("q_prior_accuracy", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(coalesce(sum(landed) {PRIOR} * 100.0 / nullif(sum(attempted) {PRIOR}, 0), 0), 9) AS accuracy, round(coalesce(avg(landed) {PRIOR}, 0), 9) AS mean_landed FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", rd(w.prior_ratio(F.col("landed"), F.col("attempted"), 100.0)).alias("accuracy"), rd(w.prior_mean(F.col("landed"))).alias("mean_landed"))


@query("q_prior_time_rates", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(coalesce(sum(landed) {PRIOR} * 60.0 / nullif(sum(seconds) {PRIOR}, 0), 0), 9) AS landed_pm, round(coalesce(sum(td_landed) {PRIOR} * 900.0 / nullif(sum(seconds) {PRIOR}, 0), 0), 9) AS td_per_15 FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", rd(w.prior_ratio(F.col("landed"), F.col("seconds"), 60.0)).alias("landed_pm"), rd(w.prior_ratio(F.col("td_landed"), F.col("seconds"), 900.0)).alias("td_per_15"))


@query("q_prior_defense", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(coalesce((sum(opp_attempted) {PRIOR} - sum(opp_landed) {PRIOR}) * 100.0 / nullif(sum(opp_attempted) {PRIOR}, 0), 0), 9) AS str_def, round(coalesce(sum(opp_landed) {PRIOR} * 60.0 / nullif(sum(seconds) {PRIOR}, 0), 0), 9) AS absorbed FROM sides")
def _(spark, d):
    s = F.col
    return side_rows(spark, d).select("bout_id", "side", rd(scalar.defense_pct(w.prior_sum(s("opp_landed")), w.prior_sum(s("opp_attempted")))).alias("str_def"), rd(w.prior_ratio(s("opp_landed"), s("seconds"), 60.0)).alias("absorbed"))


@query("q_recent_form3", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(coalesce(avg(is_win) {LAST(3)}, 0), 9) AS recent_win, round(coalesce(avg(is_win * CAST(method IN ('KO/TKO', 'Submission') AS INTEGER)) {LAST(3)}, 0), 9) AS recent_finish FROM sides")
def _(spark, d):
    s = side_rows(spark, d)
    return s.select("bout_id", "side", rd(w.last_mean(F.col("is_win"), 3)).alias("recent_win"), rd(w.last_mean(F.col("is_win") * text.is_finish(F.col("method")), 3)).alias("recent_finish"))


@query("q_finish_share", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(coalesce(sum(is_win * CAST(method = 'KO/TKO' AS INTEGER)) {PRIOR}, 0) / greatest(coalesce(sum(is_win) {PRIOR}, 0), 1), 9) AS ko_share, round(coalesce(sum(is_win * CAST(method = 'Submission' AS INTEGER)) {PRIOR}, 0) / greatest(coalesce(sum(is_win) {PRIOR}, 0), 1), 9) AS sub_share FROM sides")
def _(spark, d):
    wins = F.greatest(w.prior_sum(F.col("is_win")), F.lit(1))
    share = lambda m: rd(w.prior_sum(F.col("is_win") * (F.col("method") == m).cast("int")) / wins)
    return side_rows(spark, d).select("bout_id", "side", share("KO/TKO").alias("ko_share"), share("Submission").alias("sub_share"))


@query("q_inactivity", SIDES_SQL + f"x AS (SELECT bout_id, side, date_diff('day', lag(date) {TL}, date) AS idle FROM sides) SELECT bout_id, side, CAST(coalesce(idle, (SELECT median(idle) FROM x)) AS DOUBLE) AS idle FROM x")
def _(spark, d):
    x = side_rows(spark, d).select("bout_id", "side", w.days_since_last().alias("idle"))
    return x.crossJoin(F.broadcast(x.agg(F.median("idle").alias("m")))).select("bout_id", "side", F.coalesce(F.col("idle").cast("double"), "m").alias("idle"))


@query("q_sos5", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(coalesce(avg(opp_ctrl) {LAST(5)}, 1400), 9) AS sos FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", rd(w.last_mean(F.col("opp_ctrl"), 5, scalar.ELO_START)).alias("sos"))


@query("q_ko_vuln", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, CAST(coalesce(sum(is_loss * CAST(method = 'KO/TKO' AS INTEGER)) {PRIOR}, 0) AS BIGINT) AS ko_losses, CAST(coalesce(sum(opp_kd) {PRIOR}, 0) AS BIGINT) AS kd_received FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", w.prior_sum(F.col("is_loss") * (F.col("method") == "KO/TKO").cast("int")).alias("ko_losses"), w.prior_sum(F.col("opp_kd")).alias("kd_received"))


@query("q_ewma5", SIDES_SQL + f"x AS (SELECT bout_id, side, participant_id, landed, row_number() {TL} AS rn FROM sides) SELECT a.bout_id, a.side, round(sum(b.landed * pow(2.0 / 3, a.rn - b.rn)) / sum(pow(2.0 / 3, a.rn - b.rn)), 9) AS ewma FROM x a LEFT JOIN x b ON a.participant_id = b.participant_id AND b.rn < a.rn GROUP BY 1, 2")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", rd(w.ewma(F.col("landed").cast("double"))).alias("ewma"))


@query("q_roll_std5", SIDES_SQL + f"x AS (SELECT 1) SELECT bout_id, side, round(CASE WHEN count(landed) {LAST(5)} >= 2 THEN stddev_samp(landed) {LAST(5)} ELSE 0 END, 9) AS std FROM sides")
def _(spark, d):
    return side_rows(spark, d).select("bout_id", "side", rd(w.last_std(F.col("landed"), 5)).alias("std"))


@query("q_slope5", SIDES_SQL + f"x AS (SELECT *, CAST(row_number() {TL} AS DOUBLE) AS rn FROM sides) SELECT bout_id, side, round(CASE WHEN count(*) {LAST(5)} = 5 THEN regr_slope(landed, rn) {LAST(5)} ELSE 0 END, 9) + 0 AS slope, round(CASE WHEN count(*) {LAST(5)} >= 2 THEN regr_slope(landed, rn) {LAST(5)} ELSE 0 END, 9) + 0 AS slope_early FROM x")
def _(spark, d):
    return w.with_order(side_rows(spark, d)).select("bout_id", "side", rd(w.slope(F.col("landed").cast("double"))).alias("slope"), rd(w.slope(F.col("landed").cast("double"), 5, 2)).alias("slope_early"))


UPTO = "OVER (PARTITION BY participant_id ORDER BY ts, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def streak_sql(leading: str) -> str:
    """dn numbers the decided bouts; a streak is the distance to the last of them that ended it, and others are skipped."""
    return leading + f"""g AS (SELECT *, row_number() {TL} AS rn, CAST(sum(is_win + is_loss) {UPTO} AS BIGINT) AS dn FROM sides
), k AS (SELECT *, dn - coalesce(max(CASE WHEN is_loss = 1 THEN dn END) {UPTO}, 0) AS wa, dn - coalesce(max(CASE WHEN is_win = 1 THEN dn END) {UPTO}, 0) AS la FROM g
), s AS (SELECT *, CAST(coalesce(lag(wa) {TL}, 0) AS BIGINT) AS win_streak, CAST(coalesce(lag(la) {TL}, 0) AS BIGINT) AS loss_streak, CAST(coalesce(max(wa) {PRIOR}, 0) AS BIGINT) AS longest FROM k) """


STREAK_SQL = streak_sql(SIDES_SQL)


@query("q_win_streak", STREAK_SQL + "SELECT bout_id, side, win_streak, loss_streak FROM s")
def _(spark, d):
    return w.streaks(side_rows(spark, d)).select("bout_id", "side", "win_streak", "loss_streak")


@query("q_longest_streak", STREAK_SQL + "SELECT bout_id, side, longest FROM s")
def _(spark, d):
    return w.streaks(side_rows(spark, d)).select("bout_id", "side", w.longest_before(F.col("win_streak_after")).alias("longest"))


@query("q_career_snapshot", STREAK_SQL + f"SELECT bout_id, side, CAST(coalesce(sum(is_win) {PRIOR}, 0) AS BIGINT) AS wins, CAST(coalesce(sum(is_loss) {PRIOR}, 0) AS BIGINT) AS losses, CAST(coalesce(sum(1 - is_win - is_loss) {PRIOR}, 0) AS BIGINT) AS draws, win_streak, loss_streak, longest, CAST(coalesce(sum(greatest(ceil(seconds / 300.0), 1)) {PRIOR}, 0) AS BIGINT) AS rounds, CAST(coalesce(sum(title) {PRIOR}, 0) AS BIGINT) AS titles FROM s")
def _(spark, d):
    s = w.streaks(side_rows(spark, d))
    p = lambda x: n64(w.prior_sum(x))
    return s.select("bout_id", "side", p(F.col("is_win")).alias("wins"), p(F.col("is_loss")).alias("losses"), p(1 - F.col("is_win") - F.col("is_loss")).alias("draws"), "win_streak", "loss_streak", w.longest_before(F.col("win_streak_after")).alias("longest"), p(scalar.rounds_fought(F.col("seconds"))).alias("rounds"), p(F.col("title")).alias("titles"))


@query("q_expanding_opp_adj", SIDES_SQL + f"m AS (SELECT avg(CASE WHEN opp_ctrl > 0 THEN opp_ctrl END) AS league FROM sides), x AS (SELECT bout_id, side, landed, coalesce(avg(CASE WHEN opp_ctrl > 0 THEN opp_ctrl END) {PRIOR}, (SELECT league FROM m)) AS faced, (SELECT league FROM m) AS league FROM sides) SELECT bout_id, side, round(faced, 9) AS faced, round(landed * (league / 100) / greatest(1 - faced / 100, 0.05), 9) AS adjusted FROM x")
def _(spark, d):
    s = side_rows(spark, d)
    league = s.agg(F.avg(safe.positive(F.col("opp_ctrl"))).alias("league"))
    faced = F.coalesce(F.avg(safe.positive(F.col("opp_ctrl"))).over(w.prior()), F.col("league"))
    x = s.crossJoin(F.broadcast(league)).select("bout_id", "side", "landed", "league", faced.alias("faced"))
    return x.select("bout_id", "side", rd("faced").alias("faced"), rd(F.col("landed") * (F.col("league") / 100) / F.greatest(1 - F.col("faced") / 100, F.lit(0.05))).alias("adjusted"))


@query("q_running_average", SIDES_SQL + "x AS (SELECT 1) SELECT bout_id, side, round(sum(landed) OVER r / greatest(sum(attempted) OVER r, 1), 9) AS running FROM sides WINDOW r AS (PARTITION BY participant_id ORDER BY ts, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, d):
    s = lambda x: w.prior_sum(F.col(x), current=True)
    return side_rows(spark, d).select("bout_id", "side", rd(s("landed") / F.greatest(s("attempted"), F.lit(1))).alias("running"))


@query("q_last_n", SIDES_SQL + "x AS (SELECT participant_id, bout_id, CAST(date AS VARCHAR) AS date, opponent_id, method, CASE WHEN is_win = 1 THEN 'W' WHEN is_loss = 1 THEN 'L' ELSE 'D' END AS result, CAST(row_number() OVER (PARTITION BY participant_id ORDER BY ts DESC, bout_id DESC) AS INTEGER) AS n FROM sides) SELECT * FROM x WHERE n <= 5")
def _(spark, d):
    return serve.recent_form(side_rows(spark, d), 5).withColumn("date", day("date"))


@query("q_top_k", SIDES_SQL + "x AS (SELECT 1) SELECT participant_id, CAST(sum(is_win) AS BIGINT) AS wins FROM sides GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return ag.record(side_rows(spark, d)).select("participant_id", "wins").orderBy(F.desc("wins"), "participant_id").limit(20)


# Ratings.
def _rated(b: DataFrame) -> DataFrame:
    return b.select("bout_id", "ts", "class", "r_id", "b_id", "red_win")


def _elo_sql(key: str) -> str:
    """Replays the bouts one by one, with all ratings in a map; key: what a participant's rating is kept by."""
    k = lambda at: f"coalesce(m[{key.format(at)}], {{'e': 1400.0::DOUBLE, 'n': 0}})"
    return "WITH RECURSIVE " + BOUTS_SQL.strip().removeprefix("WITH ") + f"""
    o AS (SELECT *, row_number() OVER (ORDER BY ts, bout_id) AS i, coalesce(CAST(red_win AS DOUBLE), 0.5) AS s FROM bouts),
    st AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS bout_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y2, CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(e DOUBLE, n INTEGER))) AS m
        UNION ALL
        SELECT i, bout_id, a.e, b.e, a2, b2, map_concat(m, MAP([{key.format('r_id')}, {key.format('b_id')}], [{{'e': a2, 'n': a.n + 1}}, {{'e': b2, 'n': b.n + 1}}]))
        FROM (SELECT *, a.e + CASE WHEN a.n < 3 THEN 90 ELSE 32 END * (s - p) AS a2, b.e + CASE WHEN b.n < 3 THEN 90 ELSE 32 END * (p - s) AS b2
              FROM (SELECT *, 1 / (1 + pow(10, (b.e - a.e) / 200)) AS p
                    FROM (SELECT o.i, o.bout_id, o.r_id, o.b_id, o.class, o.s, st.m, {k('r_id')} AS a, {k('b_id')} AS b FROM st JOIN o ON o.i = st.i + 1)))
    ), elo AS (SELECT bout_id, x AS elo_r, y AS elo_b, x2 AS after_r, y2 AS after_b FROM st WHERE i > 0) """


ELO_SQL, ELO_CLASS_SQL = _elo_sql("CAST({0} AS VARCHAR)"), _elo_sql("class || ':' || {0}")
ELO_COLUMNS = "round(elo_r, 6) AS elo_r, round(elo_b, 6) AS elo_b, round(after_r, 6) AS after_r, round(after_b, 6) AS after_b"
ELO_NOW_SQL = ", long AS (SELECT ts, bout_id, r_id AS participant_id, b_id AS opponent_id, 'r' AS side, elo_r AS elo, elo_b AS opp, after_r AS after FROM bouts JOIN elo USING (bout_id) UNION ALL SELECT ts, bout_id, b_id, r_id, 'b', elo_b, elo_r, after_b FROM bouts JOIN elo USING (bout_id)), now AS (SELECT participant_id, max_by(after, (ts, bout_id)) AS elo, count(*) AS bouts FROM long GROUP BY 1) "


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rd(c, 6) for c in columns})


@query("q_elo_global", ELO_SQL + f"SELECT bout_id, {ELO_COLUMNS} FROM elo")
def _(spark, d):
    return _six(ratings.elo_global(_rated(data.bouts(spark, d))), "elo_r", "elo_b", "after_r", "after_b")


@query("q_elo_class", ELO_CLASS_SQL + f"SELECT bout_id, {ELO_COLUMNS} FROM elo")
def _(spark, d):
    return _six(ratings.elo_by_class(_rated(data.bouts(spark, d))), "elo_r", "elo_b", "after_r", "after_b")


@query("q_elo_current_class", ELO_CLASS_SQL + ", long AS (SELECT class, ts, bout_id, r_id AS participant_id, after_r AS after FROM bouts JOIN elo USING (bout_id) UNION ALL SELECT class, ts, bout_id, b_id, after_b FROM bouts JOIN elo USING (bout_id)) SELECT class, participant_id, round(max_by(after, (ts, bout_id)), 6) AS elo, count(*) AS bouts FROM long GROUP BY ALL")
def _(spark, d):
    b = _rated(data.bouts(spark, d))
    return _six(ratings.current_elo(b, ratings.elo_by_class(b), by_class=True), "elo")


@query("q_glicko_current")
def _(spark, d):
    return ratings.current_glicko(_rated(data.bouts(spark, d)))


@query("q_glicko_class")
def _(spark, d):
    return ratings.glicko_by_class(_rated(data.bouts(spark, d)))


@query("q_elo_current", ELO_SQL + ELO_NOW_SQL + "SELECT participant_id, round(elo, 6) AS elo, bouts FROM now")
def _(spark, d):
    b = data.bouts(spark, d)
    return _six(ratings.current_elo(b, ratings.elo_global(_rated(b))), "elo")


@query("q_elo_history", ELO_SQL + ELO_NOW_SQL + "SELECT bout_id, opponent_id, round(elo, 1) AS before, round(after, 1) AS after, round(after - elo, 1) AS change FROM long WHERE participant_id = 7")
def _(spark, d):
    b = data.bouts(spark, d)
    return ratings.history(b, ratings.elo_global(_rated(b)), 7).drop("ts")


# DML.
UPS = """WITH old AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS v FROM supplier WHERE s_suppkey % 4 <> 1) """


def _old_new(spark, d):
    s = table(spark, d, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"))
    new = s.where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).alias("v"))
    return old, new


@query("q_upsert", UPS + "SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NOT NULL THEN new.name ELSE old.name END AS name, round(CASE WHEN new.k IS NOT NULL THEN new.v ELSE old.v END, 9) AS v FROM old FULL JOIN new ON old.k = new.k")
def _(spark, d):
    return dml.upsert(*_old_new(spark, d), ["k"]).withColumn("v", rd("v"))


@query("q_upsert_coalesce", UPS + "SELECT coalesce(old.k, new.k) AS k, coalesce(nullif(new.name, ''), old.name) AS name, round(coalesce(new.v, old.v), 9) AS v FROM old FULL JOIN new ON old.k = new.k")
def _(spark, d):
    return dml.upsert_coalesce(*_old_new(spark, d), ["k"], ("name",)).withColumn("v", rd("v"))


@query("q_insert_ignore", UPS + "SELECT k, name, round(v, 9) AS v FROM old UNION ALL SELECT k, name, round(v, 9) FROM new WHERE k NOT IN (SELECT k FROM old)")
def _(spark, d):
    old, new = _old_new(spark, d)
    return dml.insert_ignore(dml.insert_ignore(old, new, ["k"]), new, ["k"]).withColumn("v", rd("v"))


@query("q_update", UPS + "SELECT old.k, old.name, round(CASE WHEN new.k IS NOT NULL THEN new.v ELSE old.v END, 9) AS v FROM old LEFT JOIN new ON old.k = new.k")
def _(spark, d):
    return dml.update_where(*_old_new(spark, d), ["k"], ["v"]).withColumn("v", rd("v"))


@query("q_append_missing", UPS + "SELECT k, name, round(v, 9) AS v, NULL::VARCHAR AS extra FROM old UNION ALL SELECT k, NULL, NULL, name FROM new")
def _(spark, d):
    old, new = _old_new(spark, d)
    return dml.append(dml.add_column(old, "extra", "string"), new.select("k", F.col("name").alias("extra"))).withColumn("v", rd("v"))


# Splits.
@query("q_time_split", BOUTS_SQL + "x AS (SELECT bout_id, row_number() OVER (ORDER BY ts, bout_id) - 1 AS pos, count(*) OVER () AS n FROM bouts) SELECT bout_id, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'valid' ELSE 'test' END AS split FROM x")
def _(spark, d):
    return evaluate.time_split(data.bouts(spark, d).select("bout_id", "ts"), ["ts", "bout_id"], (0.7, 0.1, 0.2), ("train", "valid", "test")).select("bout_id", "split")


@query("q_expanding_folds", BOUTS_SQL + "x AS (SELECT bout_id, row_number() OVER (ORDER BY ts, bout_id) - 1 AS pos, count(*) OVER () AS n, count(*) OVER () // 6 AS size FROM bouts), f AS (SELECT *, n - size * (5 - fold + 1) AS start FROM x, (SELECT unnest([1, 2, 3, 4, 5]) AS fold)) SELECT fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role, count(*) AS rows FROM f WHERE pos < start + size GROUP BY 1, 2")
def _(spark, d):
    return evaluate.expanding_folds(data.bouts(spark, d).select("bout_id", "ts"), ["ts", "bout_id"]).groupBy("fold", "role").agg(F.count("*").alias("rows"))


@query("q_purged_folds", "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders), s AS (SELECT min(dt) AS lo, date_diff('day', min(dt), max(dt)) AS days FROM o), f AS (SELECT o_orderkey, date_diff('day', lo, dt)::DOUBLE AS days_in, days / 6.0 AS width, fold FROM o, s, (SELECT unnest([1, 2, 3, 4, 5]) AS fold)), r AS (SELECT fold, CASE WHEN days_in >= width * fold AND (days_in < width * (fold + 1) OR (fold = 5 AND days_in <= width * (fold + 1))) THEN 'test' WHEN days_in < width * fold - 180 THEN 'train' END AS role FROM f) SELECT fold, role, count(*) AS rows FROM r WHERE role IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return evaluate.purged_folds(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt")), "dt").groupBy("fold", "role").agg(F.count("*").alias("rows"))


# Documents, html, reports.
@query("q_json_struct", BOUTS_SQL + "x AS (SELECT 1) SELECT class AS event, count(*) AS n, round(sum(round(r_ctrl / 100.0 * 100, 1)), 9) AS total FROM bouts GROUP BY 1")
def _(spark, d):
    rows = data.bouts(spark, d).select(F.col("class").alias("event"), F.lit("2024-01-01").alias("date"), F.lit("ensemble").alias("model_type"), F.col("bout_id").cast("string").alias("label"), F.col("r_id").cast("string").alias("red_name"), F.col("b_id").cast("string").alias("blue_name"), (F.col("r_ctrl") / 100.0).alias("red_prob"), (1 - F.col("r_ctrl") / 100.0).alias("blue_prob"), F.lit(1400.0).alias("elo_red"), F.lit(1400.0).alias("elo_blue"))
    parsed = sinks.parse_documents(sinks.prediction_documents(rows), schema.PREDICTION)
    return parsed.groupBy("event").agg(F.count("*").alias("n"), rd(F.sum("red_prob")).alias("total"))


@query("q_first_common_pair", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 11 ELSE 12 END AS a, CASE WHEN event_id % 3 = 0 THEN 21 ELSE 22 END AS b FROM events")
def _(spark, d):
    x = F.array(F.lit(11), F.lit(12), F.lit(13))
    y = F.array(F.when(F.col("event_id") % 3 == 0, 21), F.lit(22), F.lit(None).cast("int"))
    p = scalar.first_common(x, y)
    return table(spark, d, "events").select("event_id", p.a.alias("a"), p.b.alias("b"))


@query("q_top_two", BOUTS_SQL + "x AS (SELECT bout_id, list_sort([{'value': r_ctrl, 'name': 'red'}, {'value': b_ctrl, 'name': 'blue'}, {'value': r_kd, 'name': 'kd'}], 'DESC') AS s FROM bouts) SELECT bout_id, s[1].name AS first_name, s[2].name AS second_name FROM x")
def _(spark, d):
    t = scalar.top_two(F.array(F.lit("red"), F.lit("blue"), F.lit("kd")), F.array("r_ctrl", "b_ctrl", "r_kd"))
    return data.bouts(spark, d).select("bout_id", F.get(t, F.lit(0))["name"].alias("first_name"), F.get(t, F.lit(1))["name"].alias("second_name"))


@query("q_html_links", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, regexp_extract(html, '(?is)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1) AS first_link FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", n64(F.size(html.links(F.col("html")))).alias("n_links"), F.coalesce(F.get(html.links(F.col("html")), F.lit(0)), F.lit("")).alias("first_link"))


def _plain_sql(x: str) -> str:
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{c}')" if entity != "&nbsp;" else f"replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' ')"
    return f"trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("q_html_rows", f"""
    WITH p AS (SELECT page_id, {_plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS found FROM pages),
    x AS (SELECT page_id, title, unnest(range(len(found))) AS place, unnest(found) AS raw FROM p)
    SELECT page_id, title, CAST(place AS INTEGER) AS "at", {_plain_sql("raw")} AS paragraph FROM x""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"), F.posexplode(html.tag_text(F.col("html"), "p")).alias("at", "paragraph"))


@query("q_markdown", SCORED_SQL + """SELECT class AS event, '# ' || class || chr(10) || chr(10) || '| Bout | Pick | Confidence |' || chr(10) || '|---|---|---|' || chr(10)
    || string_agg('| ' || r_id || ' vs ' || b_id || ' | ' || CASE WHEN p_red >= 0.5 THEN r_id ELSE b_id END || ' | ' || CAST(round(CAST(CAST(greatest(p_red, 1 - p_red) * 100 AS VARCHAR) AS DECIMAL(24, 18)), 1) AS DECIMAL(5, 1)) || '%'  || ' |', chr(10) ORDER BY bout_id) || chr(10) AS report FROM scored GROUP BY 1""")
def _(spark, d):
    rows = scored(spark, d).select(F.col("class").alias("event"), F.lpad(F.col("bout_id").cast("string"), 9, "0").alias("label"), F.col("r_id").cast("string").alias("red_name"), F.col("b_id").cast("string").alias("blue_name"), F.col("p_red").alias("red_prob"))
    return sinks.markdown(rows)


# Features, models, serving.
def _features_sql(current: bool) -> str:
    """Leading expressions up to feats: the features of each side row, named as in features.FEATURES."""
    upto, start = ("CURRENT ROW", lambda n: n - 1) if current else ("1 PRECEDING", lambda n: n)
    w = "OVER (PARTITION BY participant_id ORDER BY ts, bout_id ROWS BETWEEN {} AND " + upto + ")"
    fr, last = w.format("UNBOUNDED PRECEDING"), lambda n: w.format(f"{start(n)} PRECEDING")
    total = lambda x: f"coalesce(sum({x}) {fr}, 0)"
    ratio = lambda a, b, by=1.0: f"coalesce({total(a)} * {by} / nullif({total(b)}, 0), 0)"
    won = lambda m: f"{total(f'CASE WHEN is_win = 1 AND {m} THEN 1 ELSE 0 END')} / greatest({total('is_win')}, 1)"
    defense = lambda k: f"coalesce(({total(f'opp_{k}attempted')} - {total(f'opp_{k}landed')}) * 100.0 / nullif({total(f'opp_{k}attempted')}, 0), 0)"
    ewma = lambda x: f"coalesce((SELECT sum(b.{x} * pow(2.0 / 3, f.rn - b.rn)) / sum(pow(2.0 / 3, f.rn - b.rn)) FROM f b WHERE b.participant_id = f.participant_id AND b.rn {'<=' if current else '<'} f.rn), 0)"
    decided = lambda x: f"coalesce((SELECT avg(b.{x}) FROM f b WHERE b.participant_id = f.participant_id AND b.is_win + b.is_loss = 1 AND b.dn <= f.{'dn' if current else 'dn - f.is_win - f.is_loss'} AND b.dn > f.{'dn' if current else 'dn - f.is_win - f.is_loss'} - 3), 0)"
    expressions = {
        "bouts_before": "rn" if current else "rn - 1", "wins": total("is_win"), "losses": total("is_loss"),
        "win_streak": "wa" if current else f"coalesce(lag(wa) {TL}, 0)", "loss_streak": "la" if current else f"coalesce(lag(la) {TL}, 0)", "longest": f"coalesce(max(wa) {fr}, 0)",
        "accuracy": ratio("landed", "attempted"), "td_accuracy": ratio("td_landed", "td_attempted"), "landed_pm": ratio("landed", "seconds", 60.0), "absorbed_pm": ratio("opp_landed", "seconds", 60.0),
        "td_per_15": ratio("td_landed", "seconds", 900.0), "str_def": defense(""), "td_def": defense("td_"),
        "recent_win": decided("is_win"), "recent_finish": decided("fin"), "ko_share": won("method = 'KO/TKO'"), "sub_share": won("method = 'Submission'"), "dec_share": won("method LIKE 'Decision%'"),
        "idle": "date_diff('day', date, DATE '2030-01-01')" if current else "coalesce(gap, (SELECT coalesce(median(gap), 365) FROM f))",
        "ko_losses": total("CASE WHEN is_loss = 1 AND method = 'KO/TKO' THEN 1 ELSE 0 END"), "kd_received": total("opp_kd"), "ewma_accuracy": ewma("acc"), "ewma_landed_pm": ewma("pm"),
        "std_accuracy": f"coalesce(stddev_samp(acc) {last(5)}, 0)", "slope_accuracy": f"CASE WHEN count(acc) {last(5)} >= {2 if current else 5} THEN coalesce(regr_slope(acc, rn) {last(5)}, 0) ELSE 0 END",
        "rounds": total("greatest(ceil(seconds / 300.0), 1)"), "titles": total("title"),
    }
    return STREAK_SQL.split("), s AS (")[0] + f"""), f AS (
        SELECT *, CASE WHEN attempted = 0 THEN 0 ELSE landed / (attempted + 1e-6) END AS acc, coalesce(landed * 60.0 / nullif(seconds, 0), 0) AS pm,
               CASE WHEN is_win = 1 AND method IN ('KO/TKO', 'Submission') THEN 1 ELSE 0 END AS fin, date_diff('day', lag(date) {TL}, date) AS gap FROM k
    ), feats AS (SELECT bout_id, side, participant_id, ts, date, class, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in expressions.items())} FROM f) """


@query("q_feature_matrix", _features_sql(False) + "SELECT bout_id, CAST(b.date AS VARCHAR) AS date, b.class, red_win AS target, odds_red, odds_blue, " + ", ".join(f"round(r.{f} - l.{f}, 9) + 0 AS {f}_diff" for f in features.FEATURES) + " FROM bouts b JOIN feats r USING (bout_id) JOIN feats l USING (bout_id) WHERE r.side = 'r' AND l.side = 'b' AND red_win IS NOT NULL AND r.bouts_before > 0 AND l.bouts_before > 0")
def _(spark, d):
    m = features.matrix(data.bouts(spark, d), side_rows(spark, d))
    return m.select("bout_id", day("date").alias("date"), "class", "target", "odds_red", "odds_blue", *[rd(f"{f}_diff").alias(f"{f}_diff") for f in features.FEATURES])


def _symmetry_sql() -> str:
    both = ", ".join(f"unnest([r.{f} - l.{f}, l.{f} - r.{f}]) AS {f}" for f in features.FEATURES)
    m = f", m AS (SELECT {both} FROM bouts b JOIN feats r USING (bout_id) JOIN feats l USING (bout_id) WHERE r.side = 'r' AND l.side = 'b' AND red_win IS NOT NULL AND r.bouts_before > 0 AND l.bouts_before > 0) "
    return _features_sql(False) + m + " UNION ALL ".join(f"SELECT '{f}_diff' AS \"column\", round(avg({f}), 9) + 0 AS mean, round(stddev_samp({f}), 9) AS std, abs(avg({f})) < stddev_samp({f}) AS ok FROM m" for f in features.FEATURES)


@query("q_symmetry", _symmetry_sql())
def _(spark, d):
    out = ag.symmetry(features.augmented(features.matrix(data.bouts(spark, d), side_rows(spark, d))))
    return out.withColumns({"mean": rd("mean"), "std": rd("std")})


@query("q_state", _features_sql(True) + "SELECT participant_id, bout_id, CAST(date AS VARCHAR) AS date, class, " + ", ".join(f"round({f}, 9) + 0 AS {f}" for f in features.FEATURES) + " FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY ts DESC, bout_id DESC) AS newest FROM feats) WHERE newest = 1")
def _(spark, d):
    state = features.latest_state(side_rows(spark, d), as_of=F.to_date(F.lit("2030-01-01")))
    return state.select("participant_id", "bout_id", day("date").alias("date"), "class", *[rd(F.col(f).cast("double")).alias(f) for f in features.FEATURES])


@query("q_tune")
def _(spark, d):
    train, valid, _ = _matrix_split(spark, d)
    return models.tune(train.unionByName(valid), "lr", [{"regParam": r} for r in (0.001, 0.1)], folds=3, gap_days=2)[1]


@query("q_finish_score")
def _(spark, d):
    train, _, test = _matrix_split(spark, d)
    methods = data.bouts(spark, d).select("bout_id", "method")
    fitted = models.fit_finish(models.finish_rows(train, methods))
    return models.score_finish(fitted, models.finish_rows(test, methods)).select("bout_id", "finish", "p_ko", "p_sub", "p_dec", "finish_pick")


@query("q_profile", SIDES_SQL + "x AS (SELECT participant_id, date, class, row_number() OVER (PARTITION BY participant_id ORDER BY ts DESC, bout_id DESC) AS n FROM sides), r AS (SELECT participant_id, CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(is_loss) AS BIGINT) AS losses FROM sides GROUP BY 1) SELECT participant_id, wins, losses, CAST(date AS VARCHAR) AS last_date, class AS last_class FROM r JOIN x USING (participant_id) WHERE n = 1")
def _(spark, d):
    return serve.profile(side_rows(spark, d)).select("participant_id", "wins", "losses", day("last_date").alias("last_date"), "last_class")


@query("q_compare", SIDES_SQL + "r AS (SELECT participant_id, CAST(sum(is_win) AS BIGINT) AS wins FROM sides GROUP BY 1) SELECT a.participant_id AS red, b.participant_id AS blue, a.wins - b.wins AS wins_diff, (SELECT count(*) FROM bouts WHERE least(r_id, b_id) = least(a.participant_id, b.participant_id) AND greatest(r_id, b_id) = greatest(a.participant_id, b.participant_id)) AS met FROM r a JOIN r b ON b.participant_id = a.participant_id + 1")
def _(spark, d):
    p = serve.profile(side_rows(spark, d))
    pairs = p.select(F.col("participant_id").alias("red"), (F.col("participant_id") + 1).alias("blue")).join(p.select(F.col("participant_id").alias("blue")), "blue", "left_semi")
    return serve.compare(p, pairs.select("red", "blue"), data.bouts(spark, d)).select("red", "blue", "wins_diff", "met")


@query("q_rated_matrix")
def _(spark, d):
    b, s = data.bouts(spark, d), side_rows(spark, d)
    return features.with_ratings(features.matrix(b, s), b, s)


@query("q_sos_elo", ELO_SQL + ELO_NOW_SQL + f"SELECT bout_id, side, participant_id, round(elo, 6) AS elo, round(coalesce(avg(opp) {LAST(5)}, 1400), 6) AS sos FROM long")
def _(spark, d):
    return _six(ratings.strength_of_schedule(side_rows(spark, d), ratings.elo_global(_rated(data.bouts(spark, d)))), "elo", "sos")


@query("q_sos_current", ELO_SQL + ELO_NOW_SQL + "SELECT participant_id, round(avg(elo), 6) AS sos FROM (SELECT l.participant_id, n.elo, row_number() OVER (PARTITION BY l.participant_id ORDER BY ts DESC, bout_id DESC) AS k FROM long l JOIN now n ON n.participant_id = l.opponent_id) WHERE k <= 5 GROUP BY 1")
def _(spark, d):
    b = data.bouts(spark, d)
    return _six(ratings.current_schedule(side_rows(spark, d), ratings.current_elo(b, ratings.elo_global(_rated(b)))), "sos")


@query("q_snapshot_row", BOUTS_SQL + "x AS (SELECT 1) SELECT bout_id, r_landed AS R_landed, r_kd AS R_kd, b_landed AS B_landed, b_kd AS B_kd, b_landed - r_landed AS landed_dif, b_kd - r_kd AS kd_dif FROM bouts")
def _(spark, d):
    return features.snapshot_row(longform.widen(side_rows(spark, d), ["bout_id"], ["landed", "kd"]), ["landed", "kd"], ["bout_id"])


@query("q_coverage", BOUTS_SQL + "x AS (SELECT 1) SELECT count(*) AS n, count(red_win) AS n_matched, round(count(red_win) / count(*), 9) AS share FROM bouts")
def _(spark, d):
    return ag.coverage(data.bouts(spark, d), "red_win").withColumn("share", rd("share"))


@query("q_leak_share", SIDES_SQL + f"x AS (SELECT row_number() {TL} - 1 AS h, coalesce(sum(landed) {PRIOR}, 0) AS v FROM sides) SELECT count(*) FILTER (h = 0) AS n_first, round(count(*) FILTER (h = 0 AND v <> 0) / count(*) FILTER (h = 0), 9) AS share FROM x")
def _(spark, d):
    rows = side_rows(spark, d).select(w.bouts_before().alias("bouts_before"), w.prior_sum(F.col("landed")).alias("v"))
    return ag.leak_share(rows, "v").withColumn("share", rd("share"))


@query("q_distribution", BOUTS_SQL + "x AS (SELECT 1) SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM bouts), 9) AS share FROM bouts GROUP BY class")
def _(spark, d):
    return ag.distribution(data.bouts(spark, d), "class").withColumn("share", rd("share"))


@query("q_blend_pick", SCORED_SQL + "SELECT bout_id, round(p_red * 0.7 + 0.5 * 0.3, 12) AS blended, round(greatest(p_red, 1 - p_red), 9) AS confidence, CASE WHEN p_red >= 0.5 THEN r_id ELSE b_id END AS pick, CASE WHEN p_red * 100 > 1.5 THEN round(p_red, 9) ELSE round(p_red * 100, 9) END AS fraction FROM scored")
def _(spark, d):
    p = F.col("p_red")
    return scored(spark, d).select("bout_id", rd(scalar.blend(p, F.lit(0.5), 0.3), 12).alias("blended"), rd(scalar.confidence(p)).alias("confidence"), F.when(p >= 0.5, F.col("r_id")).otherwise(F.col("b_id")).alias("pick"), rd(scalar.as_fraction(p * 100)).alias("fraction"))


def _matrix_split(spark, d):
    """Train, valid and test rows; the split matrix is written once, as every fit reads it again and again."""
    m = written(evaluate.time_split(features.matrix(data.bouts(spark, d), side_rows(spark, d)), ["ts", "bout_id"], (0.7, 0.1, 0.2), ("train", "valid", "test")), "split")
    return [m.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")]


@query("q_lr_score")
def _(spark, d):
    train, _, test = _matrix_split(spark, d)
    return models.score(models.fit("lr", features.augmented(train)), test).select("bout_id", "target", "p_red")


@query("q_ensemble_vote")
def _(spark, d):
    """All five kinds, of sizes for the test tables; weights by 500 draws on the validation rows."""
    train, valid, test = _matrix_split(spark, d)
    fitted = models.train_all(train, valid, params={"leaf": {"rounds": 6, "leaves": 8, "depth": 4, "bins": 16}, "net": {"width": 16, "blocks": 1, "epochs": 6, "batches": 2}})
    weights = models.search_weights(models.score_all(fitted, valid), [f"p_{k}" for k in fitted], tries=500)
    return models.vote(models.score_all(fitted, test), weights).select("bout_id", "target", "p_red")


@query("q_adversarial")
def _(spark, d):
    train, _, test = _matrix_split(spark, d)
    return models.adversarial(train, test)


@query("q_predict_card")
def _(spark, d):
    train, valid, _ = _matrix_split(spark, d)
    state = features.latest_state(side_rows(spark, d), as_of=F.to_date(F.lit("2030-01-01")))
    requests = state.select(F.col("participant_id").alias("red"), (F.col("participant_id") + 1).alias("blue"), F.col("participant_id").alias("request_id"))
    return serve.predict(models.train_all(train, valid, ("lr",)), requests, state)


# Streams.
QUERIES["q_stream_counts"] = stream_counts
ORACLE_SQL["q_stream_counts"] = "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"
QUERIES["q_stream_sessions"] = stream_sessions
ORACLE_SQL["q_stream_sessions"] = """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, regexp_replace(CAST(min(ts) AS VARCHAR), '0+$|\\.0+$', CASE WHEN contains(CAST(min(ts) AS VARCHAR), '.') THEN '' ELSE '\\0' END) AS start,
           regexp_replace(CAST(max(ts) + INTERVAL 6 HOUR AS VARCHAR), '0+$|\\.0+$', CASE WHEN contains(CAST(max(ts) AS VARCHAR), '.') THEN '' ELSE '\\0' END) AS "end", count(*) AS n
    FROM s GROUP BY user_id, s.n"""
QUERIES["q_stream_unique"] = stream_unique
ORACLE_SQL["q_stream_unique"] = "SELECT event_id, user_id FROM events"
QUERIES["q_stream_ingest"] = stream_ingest
ORACLE_SQL["q_stream_ingest"] = "SELECT event_id, user_id, value FROM events"
QUERIES["q_stream_career"] = stream_career
ORACLE_SQL["q_stream_career"] = STREAK_SQL + f"SELECT bout_id, participant_id, CAST(coalesce(sum(is_win) {PRIOR}, 0) AS BIGINT) AS wins, CAST(coalesce(sum(is_loss) {PRIOR}, 0) AS BIGINT) AS losses, win_streak, loss_streak, longest, CAST(coalesce(sum(landed) {PRIOR}, 0) AS BIGINT) AS landed FROM s"

# The queries of these modules are added to the same tables.
from . import catalog_models, catalog_scale, catalog_wide  # noqa: E402, F401
