"""Deltas, segmented scans, positions, no-contests: fixtures with known answers and plain definitions."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sidewind.functions import text
from sidewind.operators import dml, evaluate, joins, scans
from sidewind.operators import windows as w
from sidewind.operators.deltas import DeltaTable
from sidewind.plans import bouts as data
from sidewind.plans import catalog, features, serve, streams
from sidewind.streaming import career as stream_career
from sidewind.streaming import ingest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# No contests.
@pytest.fixture(scope="module")
def sides(spark):
    """A win by knock-out, a no contest, a win by decision of aaa; the measures are those of the published fixture."""
    bouts = [("f1", "2023-01-01", "KO/TKO", 2, 300), ("f2", "2023-06-01", "CNC", 3, 900), ("f3", "2024-01-01", "Decision - Unanimous", 3, 900)]
    stats = {"f1": [("aaa", "bbb", 1, 0, 40, 80, 2, 4), ("bbb", "aaa", 0, 1, 20, 60, 0, 2)], "f2": [("aaa", "ccc", 0, 0, 30, 70, 1, 3), ("ccc", "aaa", 0, 0, 25, 65, 0, 1)], "f3": [("aaa", "ddd", 1, 0, 50, 90, 3, 5), ("ddd", "aaa", 0, 1, 35, 75, 1, 4)]}
    rows = []
    for b, date, method, rnd, sec in bouts:
        for i, me in enumerate(stats[b]):
            other = stats[b][1 - i]
            rows.append((b, "rb"[i], date, method, rnd, sec, *me, *other[4:]))
    names = "bout_id string, side string, d string, method string, finish_round int, seconds long, participant_id string, opponent_id string, is_win int, is_loss int, landed long, attempted long, td_landed long, td_attempted long, opp_landed long, opp_attempted long, opp_td_landed long, opp_td_attempted long"
    return spark.createDataFrame(rows, names).select("*", F.to_timestamp("d").alias("ts"), F.to_date("d").alias("date"), F.lit("lightweight").alias("class"), F.lit(0).alias("title"), F.lit(0).cast("long").alias("opp_kd"))


def test_state_skips_no_contests(sides):
    r = features.latest_state(sides, as_of=F.to_date(F.lit("2024-02-01"))).where("participant_id = 'aaa'").first()
    assert (r.wins, r.losses, r.win_streak, r.loss_streak, r.longest, r.recent_win) == (2, 0, 2, 0, 2, 1.0)
    assert r.recent_finish == 0.5 and (r.rounds, r.titles) == (1 + 3 + 3, 0)
    assert round(r.accuracy, 6) == 0.5 and round(r.landed_pm, 6) == 3.428571 and round(r.absorbed_pm, 6) == 2.285714
    assert round(r.td_per_15, 6) == 2.571429 and round(r.str_def, 6) == 60.0 and round(r.td_def, 6) == 85.714286


def test_form_skips_no_contests(sides):
    got = {r.participant_id: (r.recent_win, r.recent_finish, r.win_streak) for r in serve.form(sides).collect()}
    assert got == {"aaa": (1.0, 0.5, 2), "bbb": (0.0, 1.0, 0), "ccc": (0.0, 0.0, 0), "ddd": (0.0, 0.0, 0)}
    listed = {r.n: r.result for r in serve.recent_form(sides).where("participant_id = 'aaa'").collect()}
    assert listed == {1: "W", 2: "NC", 3: "W"}


def test_stream_state_skips_no_contests_but_draws_end_streaks():
    row = {"landed": 1, "attempted": 2, "seconds": 3}
    s = dict.fromkeys(stream_career.FIELDS, 0)
    for win, loss, draw in ((1, 0, 0), (0, 0, 0), (1, 0, 0)):
        s = stream_career.advance(s, {**row, "is_win": win, "is_loss": loss, "is_draw": draw})
    assert (s["win_streak"], s["longest"], s["wins"], s["draws"], s["landed"]) == (2, 2, 2, 1, 3)
    s = stream_career.advance(s, {**row, "is_win": 0, "is_loss": 0, "is_draw": 1})
    assert (s["win_streak"], s["loss_streak"], s["longest"]) == (0, 0, 2)


@pytest.mark.parametrize("with_draws", [False, True])
def test_streaks_and_form_equal_a_loop(spark, with_draws):
    rng = random.Random(4)
    rows = [(p, i, i, *rng.choice([(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)])) for p in range(20) for i in range(rng.randrange(25))]
    df = spark.createDataFrame(rows, "participant_id int, ts int, bout_id int, is_win int, is_loss int, is_draw int")
    out = w.streaks(df, draw=F.col("is_draw") == 1 if with_draws else None).withColumns({"form": w.decided_mean(F.col("is_win"), 3), "now": w.decided_mean(F.col("is_win"), 3, True)})
    got = {(r.participant_id, r.ts): r for r in out.collect()}
    for p in range(20):
        win = loss = 0
        decided = []
        mean = lambda x: sum(x[-3:]) / len(x[-3:]) if x else 0.0
        for _, t, _, is_win, is_loss, is_draw in sorted(r for r in rows if r[0] == p):
            r = got[p, t]
            assert (r.win_streak, r.loss_streak) == (win, loss) and abs(r.form - mean(decided)) < 1e-12
            if is_win or is_loss or (with_draws and is_draw):
                win, loss = (win + 1 if is_win else 0), (loss + 1 if is_loss else 0)
            if is_win or is_loss:
                decided.append(is_win)
            assert (r.win_streak_after, r.loss_streak_after) == (win, loss) and abs(r.now - mean(decided)) < 1e-12


# Repeated keys.
def test_upserts_take_repeated_keys_in_order(spark):
    old = spark.createDataFrame([(1, "a", 0), (None, "n", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "b", 1), (1, None, 3), (1, "c", 2), (2, "x", 5), (2, "y", 4), (None, "m", 1)], "k int, v string, t int")
    assert rows_of(dml.upsert(old, new, ["k"], ("t",))) == sorted([(1, None, 3), (2, "x", 5), (None, "m", 1)], key=str)
    assert rows_of(dml.upsert_coalesce(old, new, ["k"], order=("t",))) == sorted([(1, "c", 3), (2, "x", 5), (None, "m", 1)], key=str)
    assert rows_of(dml.insert_ignore(old, new, ["k"], ("t",))) == sorted([(1, "a", 0), (2, "y", 4), (None, "n", 0)], key=str)
    pair = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    assert len({str(rows_of(dml.upsert(old.select("k", "v"), pair.repartition(n), ["k"]))) for n in (1, 2, 3)}) == 1


def replay(batches, rule, empty):
    state = {}
    for b in batches:
        for k, v, u, t in sorted(b, key=lambda r: r[3]):
            if rule == "replace" or k not in state:
                state[k] = [k, v if not (rule == "coalesce" and v == "" and empty) else None, u, t]
            elif rule == "coalesce":
                state[k] = [k, state[k][1] if v is None or (v == "" and empty) else v, state[k][2] if u is None else u, t]
    return sorted(map(tuple, state.values()), key=str)


@pytest.mark.parametrize("rule", ["replace", "coalesce", "ignore"])
def test_delta_tables_replay_batches(spark, tmp_path, rule):
    rng = random.Random(rule)
    batches = [[(rng.randrange(30), rng.choice(["", None, "a", "b"]), rng.choice([None, *range(9)]), t) for t in rng.sample(range(100 * n, 100 * n + 100), 25)] for n in range(5)]
    schema = "k int, v string, u int, t int"
    t = DeltaTable(spark, f"{tmp_path}/t", schema, ["k"], ("t",), rule, ("v",), slices=4)
    assert t.read().count() == 0
    for n, b in enumerate(batches):
        assert t.append(spark.createDataFrame(b, schema).repartition(3), f"b{n}")
        assert not t.append(spark.createDataFrame(b, schema), f"b{n}")
        if n in (1, 3):
            t.compact()
        assert rows_of(t.read()) == replay(batches[: n + 1], rule, True)
    t.compact()
    assert t.vacuum() > 0 and rows_of(t.read()) == replay(batches, rule, True) and not t.pending()
    assert not t.append(spark.createDataFrame(batches[0], schema), "b0")


def test_compaction_rewrites_only_touched_slices(spark, tmp_path):
    t = DeltaTable(spark, f"{tmp_path}/t", "k int, v int", ["k"], slices=16)
    t.append(spark.range(2000).selectExpr("CAST(id AS INT) AS k", "0 AS v"), "all")
    assert len(t.compact()) == 16
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/t/base") for f in fs if f.endswith(".parquet")}
    before = files()
    t.append(spark.createDataFrame([(5, 1), (6, 1), (7, 1)], "k int, v int"), "few")
    touched = t.compact()
    new = files() - before
    assert 1 <= len(touched) <= 3 and {f.split("_slice=")[1].split("/")[0] for f in new} == {str(k) for k in touched} and before <= files()
    assert t.read().where("v = 1").count() == 3 and t.read().count() == 2000
    # Fewer pending batches than asked for: nothing is rewritten.
    t.append(spark.createDataFrame([(8, 1)], "k int, v int"), "one")
    assert t.compact(least=2) == [] and t.read().where("v = 1").count() == 4


def test_torn_batches_are_skipped(spark, tmp_path):
    t = DeltaTable(spark, f"{tmp_path}/t", "k int, v int", ["k"], slices=2)
    t.append(spark.createDataFrame([(1, 1)], "k int, v int"), "a")
    t.append(spark.createDataFrame([(1, 2)], "k int, v int"), "b")
    os.remove(f"{tmp_path}/t/deltas/_batch=00000002~b/_SUCCESS")
    assert rows_of(t.read()) == [(1, 1)]
    assert t.append(spark.createDataFrame([(1, 3)], "k int, v int"), "b") and list(t.batches()) == [1, 3]
    assert rows_of(t.read()) == [(1, 3)]


# Scans and positions.
def skewed(n=3000):
    rng = random.Random(9)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(40)]), i, rng.randrange(100)) for i in range(n)]


def test_scan_equals_windows_and_cuts_the_hot_key(spark):
    df = spark.createDataFrame(skewed(), "k string, t int, i int, v int")
    got = scans.scan(df, ["k"], ["t", "i"], {"s": F.col("v"), "c": F.lit(1)}, {"l": F.when(F.col("v") > 70, F.col("i"))}, chunks=9)
    by = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "i")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    want = df.select("*", zero(F.col("v")).alias("s"), zero(F.lit(1)).alias("c"), F.last(F.when(F.col("v") > 70, F.col("i")), ignorenulls=True).over(upto).alias("l"))
    assert rows_of(got) == rows_of(want)
    sizes = [r["count"] for r in scans.chunked(df, ["k"], ["t", "i"], 9).groupBy("_chunk").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2 * 3000 / 9


def test_asof_scan_equals_asof(spark):
    df = spark.createDataFrame(skewed(), "k string, t int, i int, v int")
    left, right = df.where("v % 3 = 0").select("k", "t", "i"), df.where("v % 3 <> 0").select("k", F.col("t").alias("at"), F.col("i").alias("ri"), "v")
    got = scans.asof_scan(left, right, ["k"], "t", "at", ["ri", "v"], ["ri"], chunks=7)
    known = left.where("k IS NOT NULL AND t IS NOT NULL")
    want = joins.asof(known, right.where("at IS NOT NULL"), ["k"], "t", "at", ["ri", "v"], ["ri"])
    assert rows_of(got.where("k IS NOT NULL AND t IS NOT NULL")) == rows_of(want)
    rest = got.where("k IS NULL OR t IS NULL").collect()
    assert len(rest) == left.count() - known.count() and all(r.ri is None and r.at_found is None for r in rest)


def test_splits_keep_rows_without_a_time(spark):
    rows = [(i, None if i < 3 else "2024-01-01" if i < 30 else f"2024-02-{i % 28 + 1:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "bout_id int, d string").select("bout_id", F.to_date("d").alias("date"))
    pos = scans.positions(df, ["date", "bout_id"], chunks=5).collect()
    want = sorted(rows, key=lambda r: (r[1] or "", r[0]))
    assert [r.bout_id for r in sorted(pos, key=lambda r: r.pos)] == [r[0] for r in want] and {r.n for r in pos} == {60}
    split = {r.bout_id: r.split for r in evaluate.time_split(df, ["date", "bout_id"]).collect()}
    assert len(split) == 60 and [split[r[0]] for r in want] == ["train"] * 48 + ["test"] * 12
    folds = evaluate.expanding_folds(df, ["date", "bout_id"]).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in folds} == {(k, role): (10 * k if role == "train" else 10) for k in range(1, 6) for role in ("train", "test")}
    assert scans.positions(df.where("false"), ["date"]).count() == 0


# Text and ranks.
@pytest.mark.parametrize(("v", "want"), [("-150 (fav)", -150), ("−150", -150), ("+130", 130), (" 200 ", 200), ("N/A", None), ("", None), (None, None)])
def test_odds_with_words_after_them(spark, v, want):
    assert spark.createDataFrame([(v,)], "v string").select(text.american_odds(F.col("v")).alias("x")).first().x == want


def test_every_way_to_end_a_bout(spark):
    ways = [("KO/TKO", 0, 1, 1), ("TKO - Doctor's Stoppage", 0, 1, 1), ("Could Not Continue", 0, 1, 1), ("Submission", 1, 2, 1), ("Decision - Unanimous", 2, 0, 0), ("Decision - Split", 2, 0, 0), ("Decision - Majority", 2, 0, 0), ("DQ", -1, -1, 0), (None, -1, -1, 0)]
    df = spark.createDataFrame([(m,) for m, *_ in ways], "m string")
    m = F.col("m")
    assert [tuple(r) for r in df.select("m", text.finish_class(m), text.finish_number(m), text.is_finish(m)).collect()] == ways


def test_class_filter_applies_only_where_it_leaves_rows(spark):
    ranks = spark.createDataFrame([("x", "Women's Strawweight", 1, 3), ("x", "Flyweight", 2, 5), ("y", "Flyweight", 1, 0), ("y", None, 3, 9)], "name string, class string, date int, rank int")
    asked = spark.createDataFrame([("x", "women's-strawweight"), ("x", "flyweight"), ("x", "heavyweight"), ("x", None), ("y", "flyweight"), ("y", None), ("z", "flyweight")], "name string, class string")
    got = [(r.name, r["class"], r["rank"]) for r in joins.rank_in_class(asked, ranks, "name", "class", ["date"]).collect()]
    assert sorted(got, key=str) == sorted([("x", "women's-strawweight", 3), ("x", "flyweight", 5), ("x", "heavyweight", 5), ("x", None, 5), ("y", "flyweight", 0), ("y", None, 9), ("z", "flyweight", None)], key=str)


def test_records_with_an_offset(spark):
    rows = [("a", 1, 1, 1, 0, 10, 4), ("a", 2, 2, 0, 1, 10, 4), ("a", 3, 3, 1, 0, 10, 4)]
    df = spark.createDataFrame(rows, "participant_id string, ts int, bout_id int, is_win int, is_loss int, total_wins int, total_losses int")
    assert [(r.wins, r.losses) for r in w.record_with_offset(df).orderBy("ts").collect()] == [(8, 3), (9, 3), (9, 4)]


def test_career_states_cross_batches(spark, sf, tmp_path):
    """Batches of two files, in time order: states go on, and what is written in order is all rows, once."""
    rows = data.side_rows(spark, sf).select("participant_id", "bout_id", "ts", "is_win", "is_loss", "landed", "attempted", "seconds")
    streams.written_in_order(rows, f"{tmp_path}/in", 3, files=2)
    assert spark.read.parquet(f"{tmp_path}/in").exceptAll(rows).count() == 0 and spark.read.parquet(f"{tmp_path}/in").count() == rows.count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = stream_career.career(ingest.stream(spark, f"{tmp_path}/in", rows.schema, files_per_trigger=2))
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([f for f in os.listdir(f"{tmp_path}/c/commits") if f.isdigit()]) >= 3
    got = {(r.participant_id, r.bout_id): (r.wins, r.losses, r.landed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = rows.select("participant_id", "bout_id", w.prior_sum(F.col("is_win")).alias("a"), w.prior_sum(F.col("is_loss")).alias("b"), w.prior_sum(F.col("landed")).alias("c"))
    assert got == {(r.participant_id, r.bout_id): (r.a, r.b, r.c) for r in want.collect()}


def test_wide_rows_move_once(spark, sf):
    """The wide matrix deals rows of all features once, by bout, and no column that a side row itself gives before."""
    todo, wide_ones, moved = [catalog.QUERIES["q_wide_matrix"](spark, sf)._jdf.queryExecution().executedPlan().initialPlan()], 0, set()
    while todo:
        p = todo.pop()
        if p.nodeName() == "Exchange":
            names = [p.output().apply(i).name() for i in range(p.output().size())]
            wide_ones += len(names) > 50
            moved |= set(names)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert wide_ones == 1
    assert "opp_landed" in moved and not moved & {"head_landed", "opp_head_landed", "leg_attempted", "r1_ctrl"}
