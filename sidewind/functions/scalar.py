"""Dates, rates, differences, odds and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import clip, div

#: Fixed values of the rating rule.
ELO_START, ELO_DIVISOR, ELO_K_NEW, ELO_K, ELO_NEW_BOUTS = 1400.0, 200.0, 90.0, 32.0, 3
#: Weight limits by class, in pounds.
CLASS_LB = {"strawweight": 115, "flyweight": 125, "bantamweight": 135, "featherweight": 145, "lightweight": 155, "welterweight": 170, "middleweight": 185, "light heavyweight": 205, "heavyweight": 265}
UNRANKED = 16.0


# Dates.
def age_years(at: Column, born: Column) -> Column:
    return F.datediff(at, born) / F.lit(365.25)


def age_whole(at: Column, born: Column) -> Column:
    return F.floor(F.datediff(at, born) / F.lit(365)).cast("int")


def quarter_of(at: Column) -> Column:
    return F.date_trunc("quarter", at).cast("date")


def days_idle(last: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, last), F.lit(0))


def within_days(a: Column, b: Column, days: int = 1) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def sample_weight(year: Column, newest: Column, alpha: float, beta: float) -> Column:
    return F.lit(1.0) if alpha == 0 else F.exp(-alpha * F.pow((newest - year).cast("double"), F.lit(beta)))


# Rates.
def accuracy(landed: Column, attempted: Column) -> Column:
    return F.when(attempted == 0, 0.0).otherwise(landed / (attempted + F.lit(1e-6)))


def per_minute(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, div(n * 60, seconds)).otherwise(0.0)


def per_15(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, div(n * 900, seconds)).otherwise(0.0)


def defense_pct(landed_against: Column, attempted_against: Column) -> Column:
    return div((attempted_against - landed_against) * 100, attempted_against)


def round_one_seconds(round_no: Column, match_seconds: Column) -> Column:
    return F.greatest(F.when(round_no > 1, 300).otherwise(match_seconds), F.lit(1))


def rounds_fought(seconds: Column) -> Column:
    return F.greatest(F.ceil(seconds / F.lit(300)), F.lit(1)).cast("int")


def rounds_scheduled(title: Column) -> Column:
    return F.when(title.cast("boolean"), 5).otherwise(3)


def class_pounds(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in CLASS_LB.items() for x in kv])
    return F.try_element_at(pairs, F.regexp_replace(F.lower(name), "^women's ", ""))


def gender_of(name: Column) -> Column:
    return F.when(F.lower(name).startswith("women"), "F").otherwise("M")


# Pairs.
def opponent(me: Column, red: Column, blue: Column) -> Column:
    return F.when(me == red, blue).otherwise(red)


def red_win(winner: Column, red: Column, blue: Column) -> Column:
    return F.when(winner == red, 1).when(winner == blue, 0)


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def ratio_advantage(red: Column, blue: Column) -> Column:
    return F.when((red > 0) & (blue > 0), red / F.greatest(blue, F.lit(1.0)) - 1).otherwise(0.0)


def scaled_diff(red: Column, blue: Column, std: Column, least: float) -> Column:
    return (red - blue) / F.greatest(F.coalesce(std, F.lit(least)), F.lit(least))


def takedown_matchup(offense: Column, defense: Column) -> Column:
    return clip(offense * (100 - defense) / 100, 0.0, 100.0)


def stance_matchup(red: Column, blue: Column, one: str = "southpaw", other: str = "orthodox") -> Column:
    return ((red == one) & (blue == other)).cast("int") - ((red == other) & (blue == one)).cast("int")


def rank_value(rank: Column) -> Column:
    """0 is the champion; unranked is UNRANKED."""
    return F.when(rank >= 0, rank.cast("double")).otherwise(UNRANKED)


def differences(stats: list[str]) -> list[Column]:
    """red - blue of each stat, as <stat>_diff."""
    return [(F.col(f"r_{s}") - F.col(f"b_{s}")).alias(f"{s}_diff") for s in stats]


def one_hot(c: Column, vocabulary: list[str]) -> list[Column]:
    """A 0/1 column per known value; all 0 for an unknown one."""
    return [(F.lower(c) == v).cast("int").alias(f"class_{v.replace(' ', '_').replace(chr(39), '')}") for v in vocabulary]


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / ELO_DIVISOR))


# Odds.
def implied(odds: Column) -> Column:
    return F.when(odds < 0, -odds / (-odds + F.lit(100.0))).otherwise(F.lit(100.0) / (odds + 100))


def implied_decimal(odds: Column) -> Column:
    return F.when(odds > 0, 1 / odds)


def implied_fraction(text: Column) -> Column:
    p = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    a, b = F.regexp_extract(text, p, 1).try_cast("double"), F.regexp_extract(text, p, 2).try_cast("double")
    return F.try_divide(b, a + b)


def decimal_odds(odds: Column) -> Column:
    return F.when(odds < 0, 1 + F.lit(100.0) / -odds).otherwise(1 + odds / 100.0)


def fair(p_red: Column, p_blue: Column) -> Column:
    """Red's probability without the bookmaker's margin."""
    return div(p_red, p_red + p_blue, 0.5)


def kelly(edge: Column, decimal: Column, fraction: float = 0.25) -> Column:
    """Part of the stake by the Kelly rule; p is the edge plus the implied probability, margin included."""
    p = edge + 1 / decimal
    full = ((decimal - 1) * p - (1 - p)) / (decimal - 1)
    return F.when((edge <= 0) | (decimal <= 1), 0.0).otherwise(F.greatest(F.lit(0.0), full * fraction))


def blend(model: Column, market: Column, weight: float) -> Column:
    return model * (1 - weight) + market * weight


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def as_fraction(v: Column) -> Column:
    """Percent or fraction to fraction."""
    return F.when(v > 1.5, v / 100).otherwise(v)


# Arrays and structs.
def top_two(names: Column, values: Column) -> Column:
    pairs = F.zip_with(values, names, lambda v, n: F.struct(v.alias("value"), n.alias("name")))
    return F.slice(F.sort_array(pairs, asc=False), 1, 2)


def first_common(a: Column, b: Column) -> Column:
    """The first place where both arrays have a value, as struct(a, b)."""
    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.get(F.filter(zipped, lambda p: p.a.isNotNull() & p.b.isNotNull()), F.lit(0))


def lookup(pairs: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))
