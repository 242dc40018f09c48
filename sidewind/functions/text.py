"""Identity, parsing and normalisation of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class names in the order in which they are looked for, longer before shorter.
CLASSES = ["women's strawweight", "women's flyweight", "women's bantamweight", "women's featherweight", "strawweight", "flyweight", "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight", "light heavyweight", "heavyweight", "catchweight", "open weight"]
#: Method codes of finishes and their names.
FINISHES = {"KO/TKO": "KO/TKO", "SUB": "Submission", "U-DEC": "Decision - Unanimous", "S-DEC": "Decision - Split", "M-DEC": "Decision - Majority", "DQ": "DQ", "Overturned": "Overturned"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def strip_ws(c: Column) -> Column:
    """Lower-case without outer white space of any kind (trim() takes spaces alone)."""
    return F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")


def participant_id(name: Column) -> Column:
    return F.substring(F.md5(strip_ws(name).cast("binary")), 1, 16)


def bout_id(red: Column, blue: Column, date: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", red, blue, date.cast("string")).cast("binary")), 1, 16)


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z ]", ""))


def url_tail(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def x_of_y(text: Column) -> Column:
    """'X of Y', whatever follows, as struct(landed, attempted); (0, 0) if it is not that."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^\s*(\d+)\s+of\s+(\d+)", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("landed"), part(2).alias("attempted"))


def first_int(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(0))


def _clock(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+):(\d{2})", k).try_cast("int")
    return part(1) * 60 + part(2)


def clock_seconds(text: Column) -> Column:
    """'M:SS', whatever follows, in seconds; 0 if it is not that."""
    return F.coalesce(_clock(text), F.lit(0))


def elapsed_seconds(round_no: Column, clock: Column) -> Column:
    """Seconds from the start of the bout; 0 if the clock cannot be read."""
    return F.coalesce((F.greatest(round_no, F.lit(1)) - 1) * 300 + _clock(clock), F.lit(0))


def month_date(text: Column) -> Column:
    """'May. 30, 2026' and the like, full or short month names, with or without dots and comma, as a date; null if it is not that."""
    text, p = F.replace(text, F.lit("."), F.lit("")), r"^\s*([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.regexp_extract(text, p, 1), 1, 3)))
    iso = F.concat_ws("-", F.regexp_extract(text, p, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, p, 2), 2, "0"))
    return F.when(month > 0, iso.try_cast("date"))


def ordinal_date(text: Column, reference_year: Column) -> Column:
    """'Jul 18th' or 'Jul 18th 2026': without a year, that of the reference."""
    p = r"^\s*([A-Za-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})?\s*$"
    year = F.coalesce(F.nullif(F.regexp_extract(text, p, 3), F.lit("")), reference_year.cast("string"))
    return month_date(F.concat(F.regexp_extract(text, p, 1), F.lit(" "), F.regexp_extract(text, p, 2), F.lit(", "), year))


def ordered_contains(text: Column, names: list[str], otherwise: Column) -> Column:
    """The first of the names that the text contains, in either case."""
    low = F.lower(text)
    return reduce(lambda e, n: e.when(low.contains(n), n), names[1:], F.when(low.contains(names[0]), names[0])).otherwise(otherwise)


def class_of(text: Column) -> Column:
    order = [c for c in CLASSES if c != "heavyweight"] + ["heavyweight"]
    return ordered_contains(text, order, strip_ws(F.regexp_replace(F.lower(text), r"\s*bout\s*$", "")))


def method_of(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("ko"), "KO/TKO").when(low.contains("sub"), "Submission")
        .when(low.contains("s-dec") | low.contains("split"), "Decision - Split").when(low.contains("m-dec") | low.contains("majority"), "Decision - Majority")
        .when(low.contains("dec") | low.contains("unanimous"), "Decision - Unanimous")
        .when(low.contains("dq") | low.contains("disq"), "DQ").when(low.contains("no contest") | low.contains("cnc"), "CNC").otherwise(F.trim(text))
    )


def finish_name(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in FINISHES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), code)


#: Methods that end a bout early, by class.
STOPPED = ("KO/TKO", "TKO - Doctor's Stoppage", "Could Not Continue")


def finish_class(method: Column) -> Column:
    """0 knock-out or stoppage, 1 submission, 2 decision, -1 otherwise. ``finish_number`` has the classes in the order of stored models."""
    return F.when(method.isin(*STOPPED), 0).when(method == "Submission", 1).when(method.isin("Decision - Unanimous", "Decision - Split", "Decision - Majority"), 2).otherwise(-1)


def finish_number(method: Column) -> Column:
    """0 decision, 1 knock-out or stoppage, 2 submission, -1 otherwise (null too)."""
    k = finish_class(method)
    return F.when(k == 0, 1).when(k == 1, 2).when(k == 2, 0).otherwise(-1)


def is_finish(method: Column) -> Column:
    return F.coalesce(method.isin(*STOPPED, "Submission").cast("int"), F.lit(0))


def no_contest(method: Column) -> Column:
    low = F.lower(method)
    return F.coalesce(low.isin("cnc", "nc") | low.contains("no contest") | low.contains("overturned"), F.lit(False))


def height_cm(text: Column) -> Column:
    """Feet and inches; null where either is missing."""
    p = r"(\d+)'\s*(\d+)"
    feet, inches = F.regexp_extract(text, p, 1).try_cast("int"), F.regexp_extract(text, p, 2).try_cast("int")
    return F.bround((feet * 12 + inches) * F.lit(2.54), 1)


def reach_cm(text: Column) -> Column:
    """The first number, in inches, with or without a mark."""
    return F.bround(F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double") * 2.54, 1)


def american_odds(text: Column) -> Column:
    """The whole number at the start, with either minus sign, whatever follows; null if there is none."""
    return F.regexp_extract(F.replace(text, F.lit("−"), F.lit("-")), r"^\s*([+-]?\d+)", 1).try_cast("int")


def location(text: Column) -> Column:
    """'City, State, Country' as struct(city, country)."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.struct(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ", ").alias("city"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("country"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def signed(n: Column) -> Column:
    return F.when(n > 0, F.format_string("+%d", n)).otherwise(n.cast("string"))


def percent(p: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", p * 100)
