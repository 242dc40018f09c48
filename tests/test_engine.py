"""Fixtures with known answers, leakage, idempotency, html, documents, models and steps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sidewind.operators import aggregates, dml, evaluate, joins, models, ratings, windows
from sidewind.plans import bouts as data
from sidewind.plans import features, serve, steps, streams
from sidewind.sources import html, schema, sinks
from sidewind.streaming import ingest


@pytest.fixture(scope="module")
def career(spark):
    """Three bouts of participant 1: a win, no contest, a win."""
    rows = [(1, "2023-01-01", 1, 2, 1, "KO/TKO"), (2, "2023-06-01", 1, 3, None, "CNC"), (3, "2024-01-01", 1, 4, 1, "Decision - Unanimous")]
    return spark.createDataFrame(rows, "bout_id long, d string, r_id long, b_id long, winner_id long, method string").select(
        "*", F.to_timestamp("d").alias("ts"), F.lit("lightweight").alias("class"), F.when(F.col("winner_id") == F.col("r_id"), 1.0).alias("red_win")
    )


def test_elo_of_known_career(career):
    got = {r.bout_id: r for r in ratings.elo_global(career).collect()}
    assert [round(got[k].elo_r, 6) for k in (1, 2, 3)] == [1400, 1445, 1433.597083]
    last = {r.participant_id: r.elo for r in ratings.current_elo(career, ratings.elo_global(career)).collect()}
    assert {k: round(v, 6) for k, v in last.items()} == {1: 1470.000976, 2: 1355.0, 3: 1411.402917, 4: 1363.596107}


def test_glicko_published_example():
    r, rd, s = ratings.glicko_update(1500, 200, 0.06, [(1400, 30, 1), (1550, 100, 0), (1700, 300, 0)])
    assert (round(r, 1), round(rd, 1), round(s, 5)) == (1464.1, 151.5, 0.06)


def test_elo_by_class_is_elo_of_each_class(spark, sf):
    b = data.bouts(spark, sf)
    got = {r.bout_id: r.elo_r for r in ratings.elo_by_class(b).collect()}
    for k in ("click", "view"):
        want = {r.bout_id: r.elo_r for r in ratings.elo_global(b.where(F.col("class") == k)).collect()}
        assert all(abs(got[i] - v) < 1e-9 for i, v in want.items())


def test_windows_equal_pandas(spark, sf):
    s = windows.with_order(data.side_rows(spark, sf))
    got = s.select("participant_id", "ts", "bout_id", F.col("landed").cast("double").alias("x"), windows.ewma(F.col("landed").cast("double")).alias("ewma"), windows.last_std(F.col("landed"), 5).alias("std"), windows.slope(F.col("landed").cast("double")).alias("slope")).toPandas().sort_values(["participant_id", "ts", "bout_id"])
    prev = got.groupby("participant_id").x.shift(1)
    ewma = prev.groupby(got.participant_id).transform(lambda v: v.ewm(span=5, min_periods=1).mean())
    std = prev.groupby(got.participant_id).transform(lambda v: v.rolling(5, min_periods=2).std()).fillna(0)
    slope = prev.groupby(got.participant_id).transform(lambda v: v.rolling(5, min_periods=5).apply(lambda a: np.polyfit(range(5), a, 1)[0], raw=True)).fillna(0)
    for want, col in ((ewma, "ewma"), (std, "std"), (slope, "slope")):
        assert np.allclose(want.fillna(-1), got[col].astype(float).fillna(-1), atol=1e-8)


def test_streaks_equal_a_loop(spark, sf):
    got = windows.streaks(data.side_rows(spark, sf)).select("participant_id", "ts", "bout_id", "is_win", "is_loss", "win_streak", "loss_streak").toPandas().sort_values(["participant_id", "ts", "bout_id"])
    for _, g in got.groupby("participant_id"):
        w = l = 0
        for r in g.itertuples():
            assert (r.win_streak, r.loss_streak) == (w, l)
            w, l = (w + 1 if r.is_win else 0), (l + 1 if r.is_loss else 0)


def test_no_leakage(spark, sf):
    """Changing the last bout changes no earlier row."""
    s = data.side_rows(spark, sf).where("participant_id < 5")
    last = s.agg(F.max("ts")).first()[0]
    changed = s.withColumns({c: F.when(F.col("ts") == F.lit(last), F.col(c) + 5).otherwise(F.col(c)) for c in ("landed", "opp_landed", "ctrl")})
    a, b = (features.long_features(x).where(F.col("ts") < F.lit(last)).orderBy("bout_id", "side").collect() for x in (s, changed))
    assert a == b
    first = features.long_features(s).where("bouts_before = 0").collect()
    assert first and all(r.wins == r.losses == r.accuracy == r.landed_pm == 0 for r in first)


def test_asof(spark):
    l = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id int, k string, t int")
    r = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 8, 80)], "k string, at int, v int")
    got = {x.id: x.v for x in joins.asof(l, r, ["k"], "t", "at", ["v"]).collect()}
    assert got == {1: 50, 2: None, 3: None, 4: 50}
    twice = spark.createDataFrame([("a", 2, 9), ("a", 2, 10)], "k string, at int, v int")
    assert {x.id: x.v for x in joins.asof(l, twice, ["k"], "t", "at", ["v"], ["v"]).collect()} == {1: 10, 2: None, 3: None, 4: 10}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double")
    new = spark.createDataFrame([(2, "", None), (3, "c", 3.0)], "k int, name string, v double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(dml.upsert(old, new, ["k"])) == [(1, "a", 1.0), (2, "", None), (3, "c", 3.0)]
    kept = dml.upsert_coalesce(old, new, ["k"], ("name",))
    assert rows(kept) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    once = dml.insert_ignore(old, new, ["k"])
    assert rows(once) == rows(dml.insert_ignore(once, new, ["k"]))


def test_versions(spark, tmp_path):
    df = spark.range(3)
    dml.write_version(df, str(tmp_path), 1)
    dml.write_version(dml.read_latest(spark, str(tmp_path)).union(spark.range(3, 4)), str(tmp_path), 2)
    assert dml.versions(spark, str(tmp_path)) == [1, 2]
    assert dml.read_latest(spark, str(tmp_path)).count() == 4


def test_affected_holds_opponents(spark, sf):
    s = data.side_rows(spark, sf)
    got = ingest.affected(s, spark.createDataFrame([(3,)], "participant_id long"))
    assert got.groupBy("bout_id").count().where("count <> 2").isEmpty()


def test_stream_career_of_many_files(spark, sf, monkeypatch):
    """More files than a batch of the reader's default holds, in no time order, against a loop over each participant's bouts."""
    monkeypatch.setattr(streams, "side_rows", lambda *a: data.side_rows(*a).repartition(130, "bout_id"))
    got = {(r.participant_id, r.bout_id): (r.wins, r.losses, r.win_streak, r.loss_streak, r.longest) for r in streams.stream_career(spark, sf).collect()}
    want, state = {}, {}
    for r in data.side_rows(spark, sf).orderBy("ts", "bout_id").collect():
        w, l, ws, ls, longest = want[r.participant_id, r.bout_id] = state.get(r.participant_id, (0,) * 5)
        ws, ls = (ws + 1 if r.is_win else 0), (ls + 1 if r.is_loss else 0)
        state[r.participant_id] = (w + r.is_win, l + r.is_loss, ws, ls, max(longest, ws))
    assert got == want


def test_html(spark):
    p = lambda a, b: f"<td><p>{a}</p><p>{b}</p></td>"
    cells = "".join(p(*x) for x in [("A", "B"), ("1", "0"), ("50 of 100", "20 of 60"), ("50%", "33%"), ("60 of 110", "25 of 70"), ("2 of 4", "0 of 2"), ("50%", "0%"), ("1", "0"), ("0", "1"), ("1:30", "0:10")])
    df = spark.createDataFrame([(1, f"<table><tr><th>x</th></tr><tr>{cells}</tr></table>")], "id int, html string")
    r = {x.side: x for x in html.side_stats(df, keys=["id"]).collect()}
    assert (r["r"].kd, r["r"].sig_str_landed, r["b"].td_attempted, r["r"].ctrl, r["b"].reversals) == (1, 50, 2, 90, 1)
    bio = spark.createDataFrame([("<li>Height: 6' 1\"</li><li>Weight: 155</li><li>Reach: 72\"</li><li>STANCE: Orthodox</li><li>DOB: Jan 1, 1990</li>",)], "html string")
    x = html.bio(bio).first()
    assert x.stance == "Orthodox" and str(x.dob) == "1990-01-01"
    odds = spark.createDataFrame([("<tr><th>Ann</th><td></td><td>-150</td></tr><tr><th>Bea</th><td>+200</td><td>+130</td></tr>",)], "html string")
    assert tuple(html.odds_pairs(odds).first()) == ("Ann", "Bea", -150, 130)


def test_report_marks_once(spark):
    reports = spark.createDataFrame([("e", "# e\n")], "event string, report string")
    scores = spark.createDataFrame([("e", 5, 8, -0.5)], "event string, n_correct long, n long, net double")
    one = sinks.scored_report(reports, scores)
    assert "5/8" in one.first().report
    assert sinks.scored_report(one, scores).first().report == one.first().report


def test_rankings_with_odd_headers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Date,Weightclass,Fighter,Rank\n2024-01-01,Lightweight,A,0\n2024-01-01,Pound-for-Pound,B,1\n2024-01-01,Lightweight,C,\n")
    got = schema.rankings(schema.csv(spark, str(tmp_path))).collect()
    assert [(r.name, r["rank"], r["class"]) for r in got] == [("A", 0, "lightweight")]


def test_splits_are_chronological(spark, sf):
    rows = evaluate.time_split(data.bouts(spark, sf), ["ts", "bout_id"]).groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    r = {x.split: x for x in rows}
    assert r["train"].hi <= r["test"].lo


def test_models_learn_and_serve(spark, sf):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"bout_id": range(400), "a_diff": x[:, 0], "b_diff": x[:, 1], "target": (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)})
    df = spark.createDataFrame(pdf)
    m = models.fit("lr", df)
    s = models.score(m, df)
    assert s.where("p_red < 0 OR p_red > 1").isEmpty()
    assert s.select(F.avg(((F.col("p_red") >= 0.5).cast("int") == F.col("target")).cast("double"))).first()[0] > 0.85
    imp = {r.feature: r["drop"] for r in models.importance(m, df, repeats=1).collect()}
    assert imp["a_diff"] > imp["b_diff"]
    iso = models.isotonic(s, "p_red")
    assert s.select(iso(F.col("p_red")).alias("q")).where("q < 0 OR q > 1").isEmpty()


def test_serving_errors_stay_in_rows(spark, sf):
    state = features.latest_state(data.side_rows(spark, sf))
    req = spark.createDataFrame([(1, 1, 1), (2, 1, 999999), (3, 1, 2)], "request_id long, red long, blue long")
    got = {r.request_id: r.error for r in serve.request_matrix(req, state).collect()}
    assert got == {1: "same participant", 2: "blue not found", 3: None}


def test_integrity_is_clean(spark, sf):
    assert all(r.n == 0 for r in aggregates.violations(data.bouts(spark, sf), data.side_rows(spark, sf)).collect())


def test_steps(spark, sf, tmp_path):
    assert [s for _, s, _ in steps.run(spark, sf, str(tmp_path), dry=True)] == ["dry"] * len(steps.STEPS)
    got = steps.run(spark, sf, str(tmp_path), steps=[1, 6])
    assert [(n, s) for n, s, _ in got] == [("bouts", "ok"), ("checks", "ok")]


def test_empty_tables(spark, sf):
    b = data.bouts(spark, sf).where("false")
    assert ratings.elo_global(b).count() == 0
    assert features.matrix(b, data.side_rows(spark, sf).where("false")).count() == 0
