"""Rows out of html strings with regular expressions, inside the JVM.

The network is not part of the engine: pages come as a table with an html column. Cells hold the red
side's value first and the blue side's second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import first_common


def all_of(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def plain(html: Column) -> Column:
    """Text of a fragment: tags out, entities back, white space to single spaces."""
    t = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def tag_text(html: Column, tag: str) -> Column:
    return F.transform(all_of(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), plain)


def links(html: Column) -> Column:
    return all_of(html, r'(?is)<a\b[^>]*\bhref="([^"]*)"')


def table_rows(html: Column) -> Column:
    """Array of rows, each an array of its cells' html."""
    return F.transform(all_of(html, r"(?is)<tr\b[^>]*>(.*?)</tr>"), lambda r: all_of(r, r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"))


def cell(cells: Column, column: int, place: int) -> Column:
    """Text of the place-th paragraph of a cell; null if there is none."""
    return F.get(tag_text(F.get(cells, F.lit(column)), "p"), F.lit(place))


def events_list(pages: DataFrame, html: str = "html") -> DataFrame:
    """Completed events: (event_id, name, date, city, country), one row per table row with a link and a date."""
    rows = pages.select(F.explode(all_of(F.col(html), r"(?is)<tr\b[^>]*>(.*?)</tr>")).alias("r"))
    url, day = F.get(links(F.col("r")), F.lit(0)), F.regexp_extract("r", r"([A-Z][a-z]+\.?\s+\d{1,2},\s*\d{4})", 1)
    place = F.get(F.transform(all_of(F.col("r"), r"(?is)<td\b[^>]*>(.*?)</td>"), plain), F.lit(1))
    where = tx.location(place)
    return rows.select(tx.url_tail(url).alias("event_id"), plain(F.regexp_extract("r", r"(?is)<a\b[^>]*>(.*?)</a>", 1)).alias("name"), tx.month_date(day).alias("date"), where.city.alias("city"), where.country.alias("country")).where("event_id IS NOT NULL AND date IS NOT NULL")


def card(pages: DataFrame, html: str = "html") -> DataFrame:
    """An event page: (bout_id, r_id, b_id, r_name, b_name, class, method, round, clock) per table row with two participant links."""
    rows = pages.select(F.explode(all_of(F.col(html), r"(?is)(<tr\b[^>]*>.*?</tr>)")).alias("r"))
    people = F.filter(links(F.col("r")), lambda u: u.contains("fighter-details") | u.contains("participant"))
    names = all_of(F.col("r"), r'(?is)<a\b[^>]*\bhref="[^"]*(?:fighter-details|participant)[^"]*"[^>]*>(.*?)</a>')
    cells = all_of(F.col("r"), r"(?is)<td\b[^>]*>(.*?)</td>")
    bout = F.regexp_extract("r", r'data-link="([^"]*)"', 1)
    n = F.size(cells)
    return rows.where(F.size(people) >= 2).select(
        tx.url_tail(bout).alias("bout_id"), tx.url_tail(F.get(people, F.lit(0))).alias("r_id"), tx.url_tail(F.get(people, F.lit(1))).alias("b_id"),
        plain(F.get(names, F.lit(0))).alias("r_name"), plain(F.get(names, F.lit(1))).alias("b_name"),
        tx.class_of(plain(F.get(cells, n - 4))).alias("class"), tx.method_of(plain(F.get(cells, n - 3))).alias("method"),
        tx.first_int(plain(F.get(cells, n - 2))).alias("round"), plain(F.get(cells, n - 1)).alias("clock"),
    )


def side_stats(pages: DataFrame, html: str = "html", keys: list[str] | None = None) -> DataFrame:
    """A bout page's table: two rows per table row (round, in order), with the side's counts.

    Cells: 1 kd, 2 significant strikes, 4 total strikes, 5 takedowns, 7 submissions, 8 reversals, 9 control.
    """
    keys = keys or []
    rows = pages.select(*keys, F.posexplode(F.filter(table_rows(F.col(html)), lambda r: F.size(r) >= 10)).alias("at", "cells"))
    c = F.col("cells")

    def side(k: int, name: str):
        pair = lambda col, out: (tx.x_of_y(cell(c, col, k)).landed.alias(f"{out}_landed"), tx.x_of_y(cell(c, col, k)).attempted.alias(f"{out}_attempted"))
        return F.struct(F.lit(name).alias("side"), tx.first_int(cell(c, 1, k)).alias("kd"), *pair(2, "sig_str"), *pair(4, "total_str"), *pair(5, "td"), tx.first_int(cell(c, 7, k)).alias("sub_att"), tx.first_int(cell(c, 8, k)).alias("reversals"), tx.clock_seconds(cell(c, 9, k)).alias("ctrl"))

    numbered = rows.where(cell(c, 1, 0).rlike(r"^\d+$"))
    return numbered.select(*keys, F.col("at").alias("round"), F.inline(F.array(side(0, "r"), side(1, "b"))))


def bio(pages: DataFrame, html: str = "html", keys: list[str] | None = None) -> DataFrame:
    """A participant page's 'Key: value' list."""
    t = plain(F.col(html))
    value = lambda k: F.trim(F.regexp_extract(t, rf"(?i){k}:\s*(.*?)\s*(?=(?:Height|Weight|Reach|STANCE|DOB|SLpM):|$)", 1))
    return pages.select(*(keys or []), tx.height_cm(value("Height")).alias("height"), tx.reach_cm(value("Reach")).alias("reach"), F.nullif(value("STANCE"), F.lit("")).alias("stance"), tx.month_date(value("DOB")).alias("dob"))


def odds_pairs(pages: DataFrame, html: str = "html") -> DataFrame:
    """An odds table: two rows in turn are a pair; the first book that quotes both gives (a, b, odds_a, odds_b)."""
    rows = F.filter(table_rows(F.col(html)), lambda r: F.size(r) >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / 2).cast("int") - 1), lambda i: F.struct(F.get(rows, i * 2).alias("x"), F.get(rows, i * 2 + 1).alias("y")))
    df = pages.where(F.size(rows) >= 2).select(F.explode(pairs).alias("p"))
    quotes = lambda r: F.transform(F.slice(r, F.lit(2), F.size(r)), lambda x: tx.american_odds(plain(x)))
    both = first_common(quotes(F.col("p.x")), quotes(F.col("p.y")))
    return df.select(plain(F.get(F.col("p.x"), F.lit(0))).alias("a"), plain(F.get(F.col("p.y"), F.lit(0))).alias("b"), both.a.alias("odds_a"), both.b.alias("odds_b")).where("odds_a IS NOT NULL")


def odds_events(pages: DataFrame, as_of: Column, html: str = "html", base: str = "") -> DataFrame:
    """(name, url, date_text, date) of the events that an odds page heads its tables with, and of an archive's list of events.

    Days without a year are of the year of ``as_of``; a date that cannot be read is null.
    """
    # A block ends where the next one starts, so headers need no closing tag of their own.
    blocks = F.slice(F.split(F.col(html), r'(?i)<div[^>]*\bclass="[^"]*\btable-div\b'), 2, 1_000_000)
    rows = all_of(F.col(html), r"(?is)(<tr\b[^>]*>.*?</tr>)")
    found = pages.select(F.explode(F.concat(F.transform(blocks, lambda x: F.struct(x.alias("x"), F.lit("block").alias("kind"))), F.transform(rows, lambda x: F.struct(x.alias("x"), F.lit("row").alias("kind"))))).alias("f"))
    x = F.col("f.x")
    block = F.col("f.kind") == "block"
    anchor = F.when(block, F.regexp_extract(x, r"(?is)\btable-header\b.*?(<a\b[^>]*/events/[^>]*>.*?</a>)", 1)).otherwise(F.regexp_extract(x, r'(?is)content-list-title[^>]*>\s*(<a\b[^>]*>.*?</a>)', 1))
    date = plain(F.when(block, F.regexp_extract(x, r'(?is)table-header-date[^>]*>(.*?)</span>', 1)).otherwise(F.regexp_extract(x, r'(?is)content-list-date[^>]*>(.*?)</td>', 1)))
    href = F.trim(F.regexp_extract(anchor, r'(?is)\bhref=["\']([^"\']*)', 1))
    name = F.trim(F.regexp_replace(plain(anchor), r"\s+Odds$", ""))
    out = found.select(name.alias("name"), F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href).alias("url"), date.alias("date_text")).where("url <> ''")
    at = F.coalesce(tx.month_date(F.col("date_text")), tx.ordinal_date(F.col("date_text"), F.year(as_of)))
    return out.select("name", "url", "date_text", at.alias("date"))


def red_is_listed_first(html: Column, red: Column) -> Column:
    """Whether the first participant link of the table by rounds is red's; true where the page has no such link."""
    second = F.try_element_at(F.split(html, r"(?i)<section\b"), F.lit(3))
    body = F.regexp_extract(second, r"(?is)<tbody\b[^>]*>(.*?)</tbody>", 1)
    first = tx.url_tail(F.regexp_extract(body, r'(?is)<td\b[^>]*>.*?<a\b[^>]*\bhref="([^"]*)"', 1))
    return F.coalesce((first == "") | (first == red), F.lit(True))


def sided(stats: DataFrame, red_first: str = "red_first") -> DataFrame:
    """side_stats() with sides by who is red: where red_first is false, the side listed first is blue's."""
    other = F.when(F.col("side") == "r", "b").otherwise("r")
    return stats.withColumn("side", F.when(F.col(red_first), F.col("side")).otherwise(other)).drop(red_first)


def next_event(events: DataFrame, as_of: str) -> DataFrame:
    """The earliest event from a day on."""
    return events.where(F.col("date") >= F.lit(as_of).cast("date")).orderBy("date", "event_id").limit(1)


def new_events(events: DataFrame, known: DataFrame, since: str | None = None) -> DataFrame:
    """Events not ingested yet, from the high-water mark on."""
    out = events.join(known.select("event_id"), "event_id", "left_anti")
    return out.where(F.col("date") >= F.lit(since).cast("date")) if since else out
