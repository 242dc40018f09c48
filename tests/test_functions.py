"""Literal tables for parsers, rates and odds."""

import datetime

import pytest
from pyspark.sql import functions as F

from sidewind.functions import safe, scalar, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(("v", "want"), [("50 of 100", (50, 100)), ("0 of 0", (0, 0)), ("  3 of 7  ", (3, 7)), ("--", (0, 0)), ("", (0, 0)), (None, (0, 0))])
def test_x_of_y(spark, v, want):
    assert tuple(one(spark, v, text.x_of_y)) == want


@pytest.mark.parametrize(("v", "want"), [("1:30", 90), ("0:00", 0), ("4:59", 299), ("--", 0), ("", 0), (None, 0)])
def test_clock(spark, v, want):
    assert one(spark, v, text.clock_seconds) == want


@pytest.mark.parametrize(("r", "v", "want"), [(1, "2:30", 150), (3, "4:32", 872), (3, "5:00", 900), (5, "5:00", 1500)])
def test_elapsed(spark, r, v, want):
    assert one(spark, v, lambda c: text.elapsed_seconds(F.lit(r), c)) == want


@pytest.mark.parametrize(("v", "want"), [("May. 10, 2025", "2025-05-10"), ("Jan 1, 2024", "2024-01-01"), ("march 22, 2025", "2025-03-22"), ("Feb. 08, 2025", "2025-02-08"), ("not a date", None), ("Feb 31, 2024", None), (None, None)])
def test_month_date(spark, v, want):
    assert one(spark, v, text.month_date) == (want and datetime.date.fromisoformat(want))


@pytest.mark.parametrize(("v", "want"), [("Lightweight Bout", "lightweight"), ("HEAVYWEIGHT BOUT", "heavyweight"), ("Women's Strawweight Bout", "women's strawweight"), ("Light Heavyweight Bout", "light heavyweight"), ("Openish bout", "openish")])
def test_class(spark, v, want):
    assert one(spark, v, text.class_of) == want


@pytest.mark.parametrize(("v", "want"), [("KO/TKO", "KO/TKO"), ("TKO", "KO/TKO"), ("Submission", "Submission"), ("Decision - Unanimous", "Decision - Unanimous"), ("Decision - Split", "Decision - Split")])
def test_method(spark, v, want):
    assert one(spark, v, text.method_of) == want


@pytest.mark.parametrize(("v", "want"), [("http://x/fighter-details/c2299ec9", "c2299ec9"), ("http://x/fighter-details/c2299ec9/", "c2299ec9")])
def test_url_tail(spark, v, want):
    assert one(spark, v, text.url_tail) == want


@pytest.mark.parametrize(("f", "v", "want"), [(text.height_cm, "6' 1\"", 185.4), (text.reach_cm, '72"', 182.9), (text.height_cm, "--", None), (text.reach_cm, "--", None)])
def test_measures(spark, f, v, want):
    got = one(spark, v, f)
    assert got is None if want is None else abs(float(got) - want) < 0.06


@pytest.mark.parametrize(("v", "want"), [("-150", -150), ("+130", 130), ("200", 200), ("−150", -150), ("N/A", None)])
def test_american(spark, v, want):
    assert one(spark, v, text.american_odds) == want


def test_names(spark):
    assert one(spark, "Jon 'Bones' Jones", text.name_key) == "jon bones jones"
    assert one(spark, " A\tB ", text.participant_id) == one(spark, "a\tb", text.participant_id)
    assert tuple(one(spark, "Las Vegas, Nevada, USA", text.location)) == ("Las Vegas, Nevada", "USA")


@pytest.mark.parametrize(("v", "want"), [(-150.0, 0.6), (200.0, 1 / 3)])
def test_implied(spark, v, want):
    assert abs(one(spark, v, scalar.implied, "double") - want) < 1e-9


def test_odds_forms(spark):
    assert abs(one(spark, 1.667, scalar.implied_decimal, "double") - 0.6) < 1e-3
    assert abs(one(spark, "2/3", scalar.implied_fraction) - 0.6) < 1e-9
    assert one(spark, 0.0, lambda c: scalar.kelly(c, F.lit(2.0)), "double") == 0.0
    assert abs(one(spark, 0.1, lambda c: scalar.kelly(c, F.lit(2.0)), "double") - 0.05) < 1e-9


def test_safe(spark):
    assert one(spark, 0.0, lambda c: safe.div(F.lit(1.0), c), "double") == 0.0
    assert one(spark, float("nan"), safe.scrub, "double") == 0.0
    assert one(spark, float("inf"), safe.scrub, "double") == 0.0
    assert one(spark, None, lambda c: scalar.rank_value(c), "int") == 16.0
    assert one(spark, 0, lambda c: scalar.rank_value(c), "int") == 0.0
