"""Schemas of the raw tables, and reads that keep to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = ["sig_str", "total_str", "td", "head", "body", "leg", "dist", "clinch", "ground"]
_pairs = ", ".join(f"{p}_landed INT, {p}_attempted INT" for p in PAIRS)

PARTICIPANTS = "participant_id STRING, name STRING, height DOUBLE, reach DOUBLE, stance STRING, dob DATE"
BOUTS = (
    "bout_id STRING, event_id STRING, date DATE, location STRING, country STRING, class STRING, r_id STRING, b_id STRING, winner_id STRING, "
    "method STRING, finish_round INT, match_seconds INT, title INT, odds_red DOUBLE, odds_blue DOUBLE"
)
SIDES = f"bout_id STRING, participant_id STRING, side STRING, kd INT, {_pairs}, sub_att INT, reversals INT, ctrl INT, seconds INT"
SIDE_ROUNDS = f"bout_id STRING, participant_id STRING, round INT, kd INT, {_pairs}, sub_att INT, reversals INT, ctrl INT"
RANKINGS = "date DATE, class STRING, name STRING, rank INT"
PREDICTION = (
    "event STRING, date STRING, event_url STRING, model_type STRING, fights ARRAY<STRUCT<label STRING, red_name STRING, blue_name STRING, winner STRING, "
    "red_prob DOUBLE, blue_prob DOUBLE, elo_red DOUBLE, elo_blue DOUBLE, finish ARRAY<DOUBLE>, finish_str STRING, "
    "radar STRUCT<axes ARRAY<STRING>, units ARRAY<STRING>, red ARRAY<DOUBLE>, blue ARRAY<DOUBLE>>, "
    "bars STRUCT<stats ARRAY<STRING>, red ARRAY<DOUBLE>, blue ARRAY<DOUBLE>, units ARRAY<STRING>>, "
    "form STRUCT<red_streak INT, blue_streak INT, red_finish DOUBLE, blue_finish DOUBLE, red_sos DOUBLE, blue_sos DOUBLE>>>"
)


def csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV with header; with a schema no pass is spent on inference, and unread columns are pruned."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = df.schema(schema).csv(path) if schema else df.csv(path)
    return df.select(*columns) if columns else df


def json_documents(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def newest_files(spark: SparkSession, folder: str, pattern: str = "*.json", since: str | None = None, schema: str = PREDICTION) -> DataFrame:
    """Documents of a folder tree with file name and time, newest first, optionally from a day on."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    if since:
        df = df.where(F.col("modified") >= F.lit(since).cast("timestamp"))
    return df.orderBy(F.desc("modified"))


def point(df: DataFrame, column: str, value) -> DataFrame:
    """Rows by key; the comparison reaches the Parquet scan."""
    return df.where(F.col(column) == F.lit(value))


def by_header(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns found by parts of their header: {name: [parts]}, the first column holding any part."""
    picks = []
    for name, parts in wanted.items():
        hit = next((c for p in parts for c in df.columns if p in c.lower().replace("_", "")), None)
        picks.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*picks)


def rankings(raw: DataFrame) -> DataFrame:
    """Ranking snapshots from a CSV whose headers vary; pound-for-pound lists and rows without rank are left out."""
    df = by_header(raw, {"date": ["date"], "class": ["weightclass", "division", "class"], "name": ["fighter", "name", "athlete"], "rank": ["rank"]})
    rank = F.when(F.lower("rank").contains("champ"), 0).otherwise(F.col("rank").try_cast("int"))
    return df.select(F.col("date").try_cast("date").alias("date"), F.lower(F.trim("class")).alias("class"), "name", rank.alias("rank")).where("rank IS NOT NULL AND NOT class RLIKE '(?i)pound-for-pound'")


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def columns_of(df: DataFrame, prefix: str = "") -> list[str]:
    return [f.name for f in df.schema if f.name.startswith(prefix)]
