"""Queries over operators that hold at any share of a key: deltas, segmented scans, no-contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import dml, indexes, joins, scans
from ..operators import windows as w
from ..operators.deltas import DeltaTable
from ..operators.longform import sides
from ..sources import page_stream, sinks
from . import bouts as data
from . import serve
from .bouts import BOUTS_SQL, SIDES_SQL, side_rows, table
from .catalog import PRIOR, SCORED_SQL, TL, query, rd, scored, streak_sql
from .streams import folder

# No contests: every bout for a title is taken as one without a winner.
NC_SIDES_SQL = SIDES_SQL.replace("), bouts AS (", "), fought AS (", 1).replace("), sides AS (", "), bouts AS (SELECT * REPLACE (CASE WHEN title = 1 THEN NULL ELSE winner_id END AS winner_id, CASE WHEN title = 1 THEN NULL ELSE red_win END AS red_win, CASE WHEN title = 1 THEN 'CNC' ELSE method END AS method) FROM fought\n), sides AS (", 1)


def no_contest_sides(spark, d):
    b = data.bouts(spark, d)
    void = F.col("title") == 1
    b = b.withColumns({"winner_id": F.when(~void, F.col("winner_id")), "red_win": F.when(~void, F.col("red_win")), "method": F.when(void, "CNC").otherwise(F.col("method"))})
    return sides(b, data.STATS, data.BOUT)


FORM_SQL = lambda at: ", ".join(f"round(coalesce((SELECT avg(b.{x}) FROM m b WHERE b.participant_id = m.participant_id AND b.is_win + b.is_loss = 1 AND b.dn <= {at} AND b.dn > {at} - 3), 0), 9) AS {name}" for x, name in (("is_win", "recent_win"), ("fin", "recent_finish")))
NC_FORM_SQL = streak_sql(NC_SIDES_SQL) + ", m AS (SELECT *, CASE WHEN method IN ('KO/TKO', 'Submission') THEN 1 ELSE 0 END AS fin FROM s) "


@query("q_no_contest_form", NC_FORM_SQL + f"SELECT bout_id, side, win_streak, loss_streak, longest, {FORM_SQL('m.dn - m.is_win - m.is_loss')} FROM m")
def _(spark, d):
    s = w.streaks(no_contest_sides(spark, d))
    mean = lambda c: rd(w.decided_mean(c, 3))
    return s.select("bout_id", "side", "win_streak", "loss_streak", w.longest_before(F.col("win_streak_after")).alias("longest"), mean(F.col("is_win")).alias("recent_win"), mean(text.is_finish(F.col("method"))).alias("recent_finish"))


@query("q_current_form", NC_FORM_SQL + f"SELECT participant_id, {FORM_SQL('m.dn')}, wa AS win_streak FROM m QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY ts DESC, bout_id DESC) = 1")
def _(spark, d):
    return serve.form(no_contest_sides(spark, d)).withColumns({"recent_win": rd("recent_win"), "recent_finish": rd("recent_finish")})


@query("q_wins_with_offset", SIDES_SQL + f", x AS (SELECT bout_id, side, participant_id, CAST(coalesce(sum(is_win) {PRIOR}, 0) AS BIGINT) AS won, CAST(coalesce(sum(is_loss) {PRIOR}, 0) AS BIGINT) AS lost, CAST(sum(is_win) OVER (PARTITION BY participant_id) AS BIGINT) AS all_won, CAST(sum(is_loss) OVER (PARTITION BY participant_id) AS BIGINT) AS all_lost FROM sides)".replace(", x AS", "x AS", 1) + " SELECT bout_id, side, won + c_custkey % 9 - all_won AS wins, lost + c_custkey % 5 - all_lost AS losses FROM x JOIN customer ON participant_id = c_custkey")
def _(spark, d):
    """Records before each bout where a table of totals also counts bouts that are not here."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("participant_id"), (F.col("c_custkey") % 9).alias("total_wins"), (F.col("c_custkey") % 5).alias("total_losses"))
    return w.record_with_offset(side_rows(spark, d).join(c, "participant_id")).select("bout_id", "side", "wins", "losses")


# Hot keys: half of all rows are of one participant.
@query("q_prior_sums_hot", SIDES_SQL.replace("sides AS (", "plain AS (", 1) + f"""sides AS (SELECT * REPLACE (CASE WHEN bout_id % 2 = 0 THEN 0 ELSE participant_id END AS participant_id) FROM plain)
    SELECT bout_id, side, CAST(coalesce(sum(landed) {PRIOR.replace('ts, bout_id', 'ts, bout_id, side')}, 0) AS BIGINT) AS landed, CAST(coalesce(sum(is_win) {PRIOR.replace('ts, bout_id', 'ts, bout_id, side')}, 0) AS BIGINT) AS wins, row_number() {TL.replace('ts, bout_id', 'ts, bout_id, side')} - 1 AS before,
           CAST(last_value(CASE WHEN kd > 0 THEN bout_id END IGNORE NULLS) OVER (PARTITION BY participant_id ORDER BY ts, bout_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS last_kd FROM sides""")
def _(spark, d):
    s = side_rows(spark, d).withColumn("participant_id", F.when(F.col("bout_id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("participant_id"))).select("bout_id", "side", "participant_id", "ts", "landed", "is_win", "kd")
    out = scans.scan(s, ["participant_id"], ["ts", "bout_id", "side"], {"sum_landed": F.col("landed"), "wins": F.col("is_win"), "before": F.lit(1)}, {"last_kd": F.when(F.col("kd") > 0, F.col("bout_id"))})
    return out.select("bout_id", "side", F.col("sum_landed").alias("landed"), "wins", F.col("before").cast("long").alias("before"), "last_kd")


@query("q_asof_hot", """
    WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS who FROM events)
    SELECT p.event_id, s.event_id AS signup_id, s.value AS signup_value FROM (SELECT * FROM e WHERE event_type <> 'signup') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') s ON p.who = s.who AND p.ts >= s.ts""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("who", F.when(F.col("event_id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))
    right = e.where("event_type = 'signup'").select("who", F.col("ts").alias("at"), F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value"))
    return scans.asof_scan(e.where("event_type <> 'signup'").select("event_id", "who", "ts"), right, ["who"], "ts", "at", ["signup_id", "signup_value"]).select("event_id", "signup_id", "signup_value")


@query("q_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN DATE '1995-01-01' ELSE o_orderdate END AS o_orderdate FROM orders) ORDER BY ALL".replace("ORDER BY o_orderdate, o_orderkey)", "ORDER BY o_orderdate NULLS FIRST, o_orderkey)"))
def _(spark, d):
    """A tenth of the times is null, and a third of all rows falls on one day."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 10 == 0, None).when(k % 3 == 0, F.lit("1995-01-01").cast("timestamp")).otherwise(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return scans.positions(o, ["at", "o_orderkey"]).select("o_orderkey", "pos", "n")


# Upserts and delta tables.
@query("q_upsert_repeated", "WITH new AS (SELECT o_custkey AS k, o_orderkey AS last_order, o_totalprice AS v FROM orders WHERE o_custkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT coalesce(c_custkey, k) AS k, coalesce(new.last_order, -1) AS last_order, round(coalesce(v, c_acctbal), 9) AS v FROM customer FULL JOIN new ON c_custkey = k")
def _(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(None).cast("timestamp").alias("t"), F.lit(-1).cast("long").alias("last_order"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("v"))
    return dml.upsert(old, new, ["k"], ("t", "last_order")).select("k", "last_order", rd("v").alias("v"))


@query("q_delta_replay", """
    WITH x AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderdate AS t, o_orderkey % 4 AS b, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders)
    SELECT k, arg_max(i, (b, t, i)) AS last_order, round(arg_max(price, (b, t, i)) FILTER (price IS NOT NULL), 9) AS price, arg_max(priority, (b, t, i)) FILTER (priority <> '') AS priority FROM x GROUP BY k""")
def _(spark, d):
    """Four batches with repeated keys, the first two of which are compacted; then all are sent once more, which changes nothing."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_orderdate").cast("timestamp").alias("t"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"))
    t = DeltaTable(spark, f"{folder(spark)}/orders", "k long, i long, t timestamp, price double, priority string", ["k"], ("t", "i"), "coalesce", ("priority",), slices=8)
    for run in (1, 2):
        for b in range(4):
            t.append(o.where(F.col("i") % 4 == b), f"batch-{b}")
            if (run, b) == (1, 1):
                t.compact()
    return t.read().select("k", F.col("i").alias("last_order"), rd("price").alias("price"), "priority")


# Rank with a class that only counts where it leaves rows.
@query("q_rank_in_class", BOUTS_SQL + """r AS (SELECT r_id AS who, class, date, bout_id, r_ctrl % 16 AS rank FROM bouts), q AS (SELECT c_custkey AS who, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'CLI-CK' END AS class FROM customer),
    x AS (SELECT q.who, q.class, r.date, r.bout_id, r.rank, contains(replace(lower(r.class), '-', ' '), replace(lower(q.class), '-', ' ')) AS fits FROM q JOIN r USING (who)),
    y AS (SELECT *, bool_or(fits) OVER (PARTITION BY who) AS any_fits FROM x)
    SELECT q.who, CAST(coalesce(p.rank, 16) AS DOUBLE) AS rank FROM q LEFT JOIN (SELECT who, rank FROM y WHERE fits OR NOT any_fits QUALIFY row_number() OVER (PARTITION BY who ORDER BY date DESC, bout_id DESC) = 1) p USING (who)""")
def _(spark, d):
    ranks = data.bouts(spark, d).select(F.col("r_id").alias("who"), "class", "date", "bout_id", (F.col("r_ctrl") % 16).alias("rank"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("who"), F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("CLI-CK").alias("class"))
    return joins.rank_in_class(asked, ranks, "who", "class", ["date", "bout_id"]).select("who", scalar.rank_value(F.col("rank")).alias("rank"))


# Indexes and streams of pages.
@query("q_indexed_point", "SELECT o_orderkey, o_custkey, round(o_totalprice, 9) AS price FROM orders WHERE o_custkey IN (7, 77)")
def _(spark, d):
    """Two lookups in a version with ranges and filters by file."""
    root = f"{folder(spark)}/orders"
    indexes.write_indexed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), root, 1, "o_custkey", files=8)
    found = indexes.point(spark, root, "o_custkey", 7).unionByName(indexes.point(spark, root, "o_custkey", 77))
    return found.select("o_orderkey", "o_custkey", rd("o_totalprice").alias("price"))


@query("q_page_stream", "SELECT page_id, url, md5(html) AS h FROM pages")
def _(spark, d):
    """The pages as a stream with ids for offsets, run twice over one checkpoint."""
    page_stream.register(spark)
    to = folder(spark)
    pages = spark.readStream.format("sidewind_pages").option("path", f"{d}/pages.parquet").load()
    for _ in (1, 2):
        pages.writeStream.format("parquet").option("checkpointLocation", f"{to}/checkpoint").option("path", f"{to}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pages.schema).parquet(f"{to}/out").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("h"))


REPORT_SQL = SCORED_SQL + """, x AS (SELECT *, 'r' || r_id || ' vs b' || b_id AS label, round(p_red * 100, 1) AS rp, round((1 - p_red) * 100, 1) AS bp FROM scored)
    SELECT class AS event, label, CASE WHEN p_red >= 0.5 THEN 'r' || r_id ELSE 'b' || b_id END AS winner, CAST(r_ctrl AS DOUBLE) AS first_bar, CAST(b_kd AS INTEGER) AS blue_streak, seconds AS seconds FROM x"""


@query("q_bout_documents", REPORT_SQL)
def _(spark, d):
    """Documents of all classes' bouts, written and parsed again."""
    b = scored(spark, d)
    either = lambda s: [F.col(f"{s}_ctrl").alias(f"{s}_{c}") for c in ("landed_pm",)] + [F.col(f"{s}_kd").alias(f"{s}_win_streak")] + [F.lit(0.5).alias(f"{s}_{c}") for c in ("accuracy", "str_def", "td_accuracy", "td_def", "ko_share", "win_rate", "absorbed_pm", "td_per_15", "recent_finish", "sos")]
    name = lambda s: F.concat(F.lit(s), F.col(f"{s}_id").cast("string"))
    rows = b.select(F.col("class").alias("event"), F.lit("2024-01-01").alias("date"), F.lit("").alias("event_url"), F.lit("p").alias("model_type"), name("r").alias("red_name"), name("b").alias("blue_name"), F.col("p_red").alias("red_prob"), F.col("seconds").cast("double").alias("elo_red"), F.lit(1.0).alias("elo_blue"), F.lit(None).cast("array<double>").alias("finish"), *either("r"), *either("b"))
    schema = "event string, fights array<struct<label: string, winner: string, elo_red: double, bars: struct<red: array<double>>, form: struct<blue_streak: int>>>"
    fights = sinks.bout_documents(rows).select(F.from_json("document", schema).alias("d")).select("d.event", F.inline("d.fights"))
    return fights.select("event", "label", "winner", F.get("bars.red", F.lit(0)).alias("first_bar"), F.col("form.blue_streak").alias("blue_streak"), F.col("elo_red").cast("long").alias("seconds"))
