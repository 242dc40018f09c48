"""Bouts and sides over the event stream tables: event 2k is red, event 2k + 1 is blue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import red_win
from ..operators.longform import sides

#: Measures of a side.
STATS = ["landed", "attempted", "td_landed", "td_attempted", "kd", "sub_att", "ctrl"]
BOUT = ["bout_id", "ts", "date", "class", "winner_id", "method", "seconds", "finish_round", "title"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout. Both events of a bout are brought together by one aggregation on its number."""
    e = table(spark, sf_dir, "events").select(
        F.expr("event_id div 2").alias("bout_id"), (F.col("event_id") % 2).alias("half"), "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )
    half = lambda n: F.max(F.when(F.col("half") == n, F.struct("ts", "user_id", "event_type", "value", "k")))
    b = e.groupBy("bout_id").agg(half(0).alias("r"), half(1).alias("b")).where("r.user_id <> b.user_id")
    k = F.col("r.k")

    def stats(side: str):
        v, n = F.floor(F.col(f"{side}.value")).cast("long"), F.col(f"{side}.k").cast("long")
        return [
            v.alias(f"{side}_landed"), (v + n).alias(f"{side}_attempted"), (n % 7).alias(f"{side}_td_landed"), (n % 7 + 3).alias(f"{side}_td_attempted"),
            (n % 3).alias(f"{side}_kd"), (n % 2).alias(f"{side}_sub_att"), n.alias(f"{side}_ctrl"),
        ]

    line = F.when(k % 2 == 0, -(k + 100)).otherwise(k + 100).cast("double")
    return b.select(
        "bout_id", F.greatest("r.ts", "b.ts").alias("ts"), F.greatest("r.ts", "b.ts").cast("date").alias("date"), F.col("r.user_id").alias("r_id"), F.col("b.user_id").alias("b_id"),
        F.col("r.event_type").alias("class"), F.when(F.col("r.value") > F.col("b.value"), F.col("r.user_id")).when(F.col("b.value") > F.col("r.value"), F.col("b.user_id")).alias("winner_id"),
        F.element_at(F.array(F.lit("KO/TKO"), F.lit("Submission"), F.lit("Decision - Unanimous"), F.lit("Decision - Split")), (k % 4 + 1).cast("int")).alias("method"),
        (k + 60 + (k % 3) * 300).cast("long").alias("seconds"), (k % 3 + 1).cast("int").alias("finish_round"), (k % 5 == 0).cast("int").alias("title"),
        line.alias("odds_red"), (-line).alias("odds_blue"), *stats("r"), *stats("b"),
    ).withColumn("red_win", red_win(F.col("winner_id"), F.col("r_id"), F.col("b_id")))


def side_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(bouts(spark, sf_dir), STATS, BOUT)


#: The same in the oracle's dialect, as leading common table expressions.
BOUTS_SQL = """
WITH half AS (
    SELECT event_id // 2 AS bout_id, event_id % 2 AS half, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), bouts AS (
    SELECT r.bout_id, greatest(r.ts, b.ts) AS ts, CAST(greatest(r.ts, b.ts) AS DATE) AS date, r.user_id AS r_id, b.user_id AS b_id, r.event_type AS class,
           CASE WHEN r.value > b.value THEN r.user_id WHEN b.value > r.value THEN b.user_id END AS winner_id,
           CASE WHEN r.value > b.value THEN 1 WHEN b.value > r.value THEN 0 END AS red_win,
           CASE r.k % 4 WHEN 0 THEN 'KO/TKO' WHEN 1 THEN 'Submission' WHEN 2 THEN 'Decision - Unanimous' ELSE 'Decision - Split' END AS method,
           r.k + 60 + (r.k % 3) * 300 AS seconds, CAST(r.k % 3 + 1 AS INTEGER) AS finish_round, CAST(r.k % 5 = 0 AS INTEGER) AS title,
           CAST(CASE WHEN r.k % 2 = 0 THEN -(100 + r.k) ELSE 100 + r.k END AS DOUBLE) AS odds_red, CAST(CASE WHEN r.k % 2 = 0 THEN 100 + r.k ELSE -(100 + r.k) END AS DOUBLE) AS odds_blue,
           CAST(floor(r.value) AS BIGINT) AS r_landed, CAST(floor(r.value) AS BIGINT) + r.k AS r_attempted, r.k % 7 AS r_td_landed, r.k % 7 + 3 AS r_td_attempted, r.k % 3 AS r_kd, r.k % 2 AS r_sub_att, r.k AS r_ctrl,
           CAST(floor(b.value) AS BIGINT) AS b_landed, CAST(floor(b.value) AS BIGINT) + b.k AS b_attempted, b.k % 7 AS b_td_landed, b.k % 7 + 3 AS b_td_attempted, b.k % 3 AS b_kd, b.k % 2 AS b_sub_att, b.k AS b_ctrl
    FROM half r JOIN half b ON r.bout_id = b.bout_id AND r.half = 0 AND b.half = 1 WHERE r.user_id <> b.user_id
), """
_side = lambda me, other: f"""SELECT bout_id, ts, date, class, winner_id, method, seconds, finish_round, title, '{me}' AS side, {me}_id AS participant_id, {other}_id AS opponent_id,
           {', '.join(f'{me}_{s} AS {s}' for s in STATS)}, {', '.join(f'{other}_{s} AS opp_{s}' for s in STATS)},
           CASE WHEN winner_id = {me}_id THEN 1 ELSE 0 END AS is_win, CASE WHEN winner_id <> {me}_id THEN 1 ELSE 0 END AS is_loss FROM bouts"""  # noqa: E731
SIDES_SQL = BOUTS_SQL + f"""sides AS (
    {_side('r', 'b')}
    UNION ALL
    {_side('b', 'r')}
), """
