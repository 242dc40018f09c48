"""Documents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confidence
from ..functions.text import percent, signed


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def prediction_documents(rows: DataFrame) -> DataFrame:
    """One JSON document per event from rows(event, date, model_type, label, red_name, blue_name, red_prob, blue_prob, elo_red, elo_blue)."""
    fight = F.struct(
        "label", "red_name", "blue_name", F.when(F.col("red_prob") >= F.col("blue_prob"), F.col("red_name")).otherwise(F.col("blue_name")).alias("winner"),
        F.bround(F.col("red_prob") * 100, 1).alias("red_prob"), F.bround(F.col("blue_prob") * 100, 1).alias("blue_prob"), "elo_red", "elo_blue",
    )
    g = rows.groupBy("event", "date", "model_type").agg(F.array_sort(F.collect_list(fight)).alias("fights"))
    return g.select("event", F.to_json(F.struct("event", "date", "model_type", "fights")).alias("document"))


def parse_documents(df: DataFrame, schema: str, column: str = "document") -> DataFrame:
    """One row per bout of each document."""
    return df.select(F.from_json(column, schema).alias("d")).select("d.event", "d.date", F.posexplode("d.fights").alias("at", "f")).select("event", "date", "at", "f.*")


def card_line(red: Column, blue: Column, p_red: Column) -> Column:
    pick = F.when(p_red >= 0.5, red).otherwise(blue)
    return F.concat(F.lit("| "), red, F.lit(" vs "), blue, F.lit(" | "), pick, F.lit(" | "), percent(confidence(p_red)), F.lit(" |"))


def markdown(rows: DataFrame) -> DataFrame:
    """A report per event from rows(event, label, red_name, blue_name, red_prob)."""
    line = F.struct("label", card_line(F.col("red_name"), F.col("blue_name"), F.col("red_prob")).alias("line"))
    g = rows.groupBy("event").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.concat(F.lit("# "), F.col("event"), F.lit("\n\n| Bout | Pick | Confidence |\n|---|---|---|\n"))
    return g.select("event", F.concat(head, F.array_join(F.transform("lines", lambda x: x.line), "\n"), F.lit("\n")).alias("report"))


#: Parts of a bout's document: what the radar and the bars show, by the state's column.
RADAR = {"Striking accuracy": "accuracy", "Striking defense": "str_def", "Takedown accuracy": "td_accuracy", "Takedown defense": "td_def", "Knock-outs per win": "ko_share", "Win rate": "win_rate"}
BARS = {"Strikes/min": "landed_pm", "Str absorbed/min": "absorbed_pm", "TD avg/15min": "td_per_15", "Win streak": "win_streak"}
BAR_UNITS = ["/min", "/min", "/15min", ""]
FINISHES = ("Decision", "KO/TKO", "Submission")


def finish_line(shares: Column) -> Column:
    """'KO/TKO 45%, Decision 40%, Submission 15%' of an array in the order of FINISHES, most likely first; empty without shares."""
    named = F.transform(shares, lambda p, i: F.struct((-p).alias("p"), i.alias("i"), F.concat(F.element_at(F.array(*map(F.lit, FINISHES)), i + 1), F.lit(" "), percent(p, 0)).alias("s")))
    return F.coalesce(F.array_join(F.transform(F.array_sort(named), lambda x: x.s), ", "), F.lit(""))


def _of_hundred(c: Column) -> Column:
    """Shares and percentages alike, in percent to one place."""
    x = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.bround(F.when(x > 1.5, x).otherwise(x * 100), 1)


def bout_documents(rows: DataFrame) -> DataFrame:
    """One JSON document per event, each bout with its finish line, radar, bars and form.

    rows: event, date, event_url, model_type, red_name, blue_name, red_prob, elo_red, elo_blue, finish (array of three shares, or
    null), and for either side r_ and b_ the columns of RADAR and BARS, recent_finish and sos. Unknown numbers count as 0.
    """
    num = lambda c, digits: F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), digits)
    side = lambda s, of: F.array(*[_of_hundred(F.col(f"{s}_{c}")) if of is RADAR else num(f"{s}_{c}", 2) for c in of.values()])
    texts = lambda names: F.array(*[F.lit(n) for n in names])
    red = F.col("red_prob")
    bout = F.struct(
        F.concat("red_name", F.lit(" vs "), "blue_name").alias("label"), "red_name", "blue_name", F.when(red >= 0.5, F.col("red_name")).otherwise(F.col("blue_name")).alias("winner"),
        F.bround(red * 100, 1).alias("red_prob"), F.bround((1 - red) * 100, 1).alias("blue_prob"), num("elo_red", 0).alias("elo_red"), num("elo_blue", 0).alias("elo_blue"),
        F.coalesce("finish", F.array().cast("array<double>")).alias("finish"), finish_line(F.col("finish")).alias("finish_str"),
        F.struct(texts(RADAR).alias("axes"), texts(["%"] * len(RADAR)).alias("units"), side("r", RADAR).alias("red"), side("b", RADAR).alias("blue")).alias("radar"),
        F.struct(texts(BARS).alias("stats"), side("r", BARS).alias("red"), side("b", BARS).alias("blue"), texts(BAR_UNITS).alias("units")).alias("bars"),
        F.struct(
            *[num(f"{s}_win_streak", 0).cast("int").alias(f"{n}_streak") for s, n in (("r", "red"), ("b", "blue"))], *[_of_hundred(F.col(f"{s}_recent_finish")).alias(f"{n}_finish") for s, n in (("r", "red"), ("b", "blue"))],
            *[F.bround(F.coalesce(F.col(f"{s}_sos").cast("double"), F.lit(1400.0)), 0).alias(f"{n}_sos") for s, n in (("r", "red"), ("b", "blue"))],
        ).alias("form"),
    )
    g = rows.groupBy("event", "date", "event_url", "model_type").agg(F.array_sort(F.collect_list(bout)).alias("fights"))
    return g.select("event", F.to_json(F.struct("event", "date", "event_url", "model_type", "fights")).alias("document"))


def full_report(rows: DataFrame) -> DataFrame:
    """(event, report): the card's table with the likely method, then each bout's ratings, form and probabilities. Columns as in bout_documents()."""
    share = lambda c: percent(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 0)
    whole = lambda c: F.coalesce(F.bround(F.col(c).cast("double"), 0).cast("long"), F.lit(0)).cast("string")
    form = lambda n, s: F.concat(F.col(n), F.lit(" win_rate="), share(f"{s}_recent_win"), F.lit(" finish_rate="), share(f"{s}_recent_finish"), F.lit(" streak="), whole(f"{s}_win_streak"))
    line = finish_line(F.col("finish"))
    table = F.concat(card_line(F.col("red_name"), F.col("blue_name"), F.col("red_prob")), F.lit(" "), line, F.lit(" |"))
    raw = F.concat(
        F.lit("### "), "red_name", F.lit(" vs "), "blue_name", F.lit("\n- ELO: "), "red_name", F.lit(" "), whole("elo_red"), F.lit(" | "), "blue_name", F.lit(" "), whole("elo_blue"), F.lit("\n- Recent form: "), form("red_name", "r"), F.lit(" | "), form("blue_name", "b"),
        F.lit("\n- "), "model_type", F.lit(": "), "red_name", F.lit(" "), percent(F.col("red_prob")), F.lit(" | "), "blue_name", F.lit(" "), percent(1 - F.col("red_prob")), F.lit("\n- Finish: "), line, F.lit("\n"),
    )
    bouts = F.struct(F.concat("red_name", F.lit(" vs "), "blue_name").alias("label"), table.alias("line"), raw.alias("raw"))
    g = rows.groupBy("event", "date", "model_type").agg(F.array_sort(F.collect_list(bouts)).alias("b"))
    head = F.concat(F.lit("# "), "event", F.lit(" -- "), F.date_format("date", "MMMM d, yyyy"), F.lit("\n\nModel: "), "model_type", F.lit("\n\n## Predictions\n\n| Bout | Pick | Confidence | Likely method |\n|---|---|---|---|\n"))
    return g.select("event", F.concat(head, F.array_join(F.transform("b", lambda x: x.line), "\n"), F.lit("\n\n## Raw output\n\n"), F.array_join(F.transform("b", lambda x: x.raw), "\n")).alias("report"))


def escaped(c: Column) -> Column:
    """Text as it may stand in a page."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def html_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns])
    row = F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select(key, F.concat(F.lit(f"<table>{head}"), F.array_join("rows", ""), F.lit("</table>")).alias("html"))


def scored_report(reports: DataFrame, scores: DataFrame, marker: str = "## Results") -> DataFrame:
    """Appends the score to reports(event, report); a report that has the marker stays as it is."""
    tail = F.concat(F.lit(f"\n{marker}\n\n"), F.col("n_correct").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" ("), percent(F.col("n_correct") / F.col("n")), F.lit("), net "), signed(F.bround(F.col("net") * 100).cast("int")), F.lit("\n"))
    out = reports.join(scores, "event", "left")
    done = F.col("report").contains(marker) | F.col("n").isNull()
    return out.select("event", F.when(done, F.col("report")).otherwise(F.concat("report", tail)).alias("report"))
