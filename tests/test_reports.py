"""Documents, reports, odds pages and the command line's answers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sidewind.operators import dml, ratings
from sidewind.plans import bouts as data
from sidewind.plans import predict, steps
from sidewind.sources import html, sinks


@pytest.fixture(scope="module")
def card(spark):
    rows = [
        ("E & F", "2026-06-06", "http://e", "vote", "Ann <A>", "Bea", 0.625, 1500.4, 1399.6, [0.2, 0.5, 0.3], 0.5, 60.0, 0.4, 0.0, 0.5, 1.0, 3.428, 2.2, 2.5, 2, 1.0, 0.5, 1450.2),
        ("E & F", "2026-06-06", "http://e", "vote", "Cid", "Dee", 0.4, None, 1400.0, None, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0, 2.0, 3.0, 0, 0.0, 0.0, None),
    ]
    names = "event string, d string, event_url string, model_type string, red_name string, blue_name string, red_prob double, elo_red double, elo_blue double, finish array<double>, r_accuracy double, r_str_def double, r_td_accuracy double, r_td_def double, r_ko_share double, r_win_rate double, r_landed_pm double, r_absorbed_pm double, r_td_per_15 double, r_win_streak int, r_recent_win double, r_recent_finish double, r_sos double"
    df = spark.createDataFrame(rows, names).withColumn("date", F.to_date("d")).drop("d")
    return df.select("*", *[F.lit(0.25).alias("b_" + c[2:]) for c in df.columns if c.startswith("r_")])


def test_documents_hold_radar_bars_and_form(card):
    doc = json.loads(sinks.bout_documents(card).first().document)
    a, b = doc["fights"]
    assert (doc["event"], doc["date"], doc["event_url"], doc["model_type"]) == ("E & F", "2026-06-06", "http://e", "vote")
    assert (a["label"], a["winner"], a["red_prob"], a["blue_prob"], a["elo_red"]) == ("Ann <A> vs Bea", "Ann <A>", 62.5, 37.5, 1500.0)
    assert a["finish"] == [0.2, 0.5, 0.3] and a["finish_str"] == "KO/TKO 50%, Submission 30%, Decision 20%"
    assert a["radar"]["red"] == [50.0, 60.0, 40.0, 0.0, 50.0, 100.0] and len(a["radar"]["axes"]) == len(a["radar"]["units"]) == 6
    assert a["bars"]["red"] == [3.43, 2.2, 2.5, 2.0] and a["bars"]["units"] == ["/min", "/min", "/15min", ""] and len(a["bars"]["stats"]) == 4
    assert a["form"] == {"red_streak": 2, "blue_streak": 0, "red_finish": 50.0, "blue_finish": 25.0, "red_sos": 1450.0, "blue_sos": 0.0}
    assert (b["winner"], b["elo_red"], b["finish"], b["finish_str"], b["form"]["red_sos"]) == ("Dee", 0.0, [], "", 1400.0)


def test_report_has_every_part(card):
    text = sinks.full_report(card).first().report
    assert text.startswith("# E & F -- June 6, 2026\n\nModel: vote\n")
    assert "| Ann <A> vs Bea | Ann <A> | 62.5% | KO/TKO 50%, Submission 30%, Decision 20% |" in text and "| Cid vs Dee | Dee | 60.0% |  |" in text
    assert "- ELO: Ann <A> 1500 | Bea 1400" in text and "win_rate=100% finish_rate=50% streak=2" in text and "- vote: Cid 40.0% | Dee 60.0%" in text


def test_cells_are_escaped(card):
    page = sinks.html_table(card, "event", ["red_name", "finish"]).first().html
    assert "<td>Ann &lt;A&gt;</td>" in page and "<A>" not in page


ODDS = """<div class="table-div"><div class="table-header"><a href="/events/big-1"><h1>Big One Odds</h1></a><span class="table-header-date">Jul 18th</span></div><table><tr><td>x</td></tr></table></div>
<div id="2" class="x table-div"><div class="table-header"><a href="http://o/events/two">Second &amp; Last Odds</a></div></div><div class="table-div">no header</div>
<table class="content-list"><tr><td class="content-list-date">May 30, 2026</td><td class="content-list-title"><a href="/events/old-3">Old Three</a></td></tr><tr><td>head</td></tr></table>"""


def test_odds_pages_as_events(spark):
    df = spark.createDataFrame([(ODDS,), ("",), (None,)], "html string")
    got = [tuple(r) for r in html.odds_events(df, F.to_date(F.lit("2026-07-01")), base="http://o").withColumn("date", F.col("date").cast("string")).collect()]
    assert sorted(got) == sorted([("Big One", "http://o/events/big-1", "Jul 18th", "2026-07-18"), ("Second & Last", "http://o/events/two", "", None), ("Old Three", "http://o/events/old-3", "May 30, 2026", "2026-05-30")])


def rounds(first, second):
    return f'<section class="s">a</section><section class="s"><table><tbody class="b"><tr><td><p><a href="http://x/fighter-details/{first}">A</a></p><p><a href="http://x/fighter-details/{second}">B</a></p></td></tr></tbody></table></section>'


@pytest.mark.parametrize(("page", "want"), [(rounds("r1", "b1"), True), (rounds("b1", "r1"), False), ("<section>one</section>", True), ("", True), (None, True)])
def test_who_is_listed_first(spark, page, want):
    assert spark.createDataFrame([(page, "r1")], "html string, red string").select(html.red_is_listed_first(F.col("html"), F.col("red")).alias("x")).first().x is want


def test_sides_follow_who_is_red(spark):
    df = spark.createDataFrame([(1, "r", 5, False), (1, "b", 7, False), (2, "r", 1, True)], "bout int, side string, kd int, red_first boolean")
    assert {(r.bout, r.side): r.kd for r in html.sided(df).collect()} == {(1, "b"): 5, (1, "r"): 7, (2, "r"): 1}


def test_answers_of_a_card(spark, sf):
    fitted, weights, state = predict.trained(spark, sf, "lr")
    ids = [r.participant_id for r in state.orderBy("participant_id").limit(2).collect()]
    asked = [{"red": ids[0], "blue": ids[1], "odds_red": "-150", "odds_blue": "130"}, {"red": ids[0], "blue": ids[0]}, {"red": ids[0], "blue": 10**9}]
    got = predict.answers(spark, fitted, weights, state, asked)
    assert abs(got[0]["p_red"] + got[0]["p_blue"] - 1) < 1e-12 and got[0]["pick"] in ids and got[0]["confidence"] >= 0.5 and "edge_red" in got[0]
    assert got[1]["error"] == "same participant" and got[2]["error"] == "blue not found" and "pick" not in got[1]
    market = predict.answers(spark, fitted, weights, state, asked[:1], blend=1.0)[0]
    assert abs(market["p_red"] - got[0]["fair_red"]) < 1e-9
    with pytest.raises(ValueError, match="at most"):
        predict.answers(spark, fitted, weights, state, asked * 6)
    assert predict.answers(spark, fitted, weights, state, []) == []


def test_steps_run_again(spark, sf, tmp_path):
    out = str(tmp_path)
    assert set(steps.health(spark, out).values()) == {0}
    for _ in (1, 2):
        assert [s for _, s, _ in steps.run(spark, sf, out, steps=[7, 8, 9])] == ["ok"] * 3
    assert {k: v for k, v in steps.health(spark, out).items() if v} == {"rating_state": 2, "rating_position": 2, "predictions": 2}
    # The second run replays nothing and adds no batch.
    assert steps.refresh_ratings(spark, sf, out) == 0
    assert len(os.listdir(f"{out}/bouts_delta/deltas")) == 1
    b = data.bouts(spark, sf)
    want = {(r["class"], r.participant_id): round(r.elo, 9) for r in ratings.current_elo(b, ratings.elo_by_class(b), by_class=True).collect()}
    assert {(r["class"], r.participant_id): round(r.elo, 9) for r in dml.read_latest(spark, f"{out}/rating_state").collect()} == want
