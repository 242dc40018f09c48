"""Incremental ingest: batches that apply once, and streams over new files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deltas import DeltaTable


def high_water(df: DataFrame, date: str = "date"):
    return df.agg(F.max(date)).first()[0]


def newer(df: DataFrame, mark, date: str = "date") -> DataFrame:
    return df if mark is None else df.where(F.col(date) > F.lit(mark))


def pending(bouts: DataFrame, done: DataFrame) -> DataFrame:
    """Bouts without child rows yet."""
    return bouts.join(done.select("bout_id"), "bout_id", "left_anti")


def affected(side_rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Rows to compute anew for these participants: all of theirs, and their opponents' rows of the same bouts."""
    mine = side_rows.join(participants.select("participant_id"), "participant_id", "left_semi").select("bout_id").distinct()
    return side_rows.join(mine, "bout_id", "left_semi")


def stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = 100) -> DataFrame:
    """files_per_trigger: None puts all files that are there into one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def delta_table(spark: SparkSession, root: str, like: DataFrame, keys: list[str], merge: bool = False, order: tuple[str, ...] = (), slices: int = 16) -> DeltaTable:
    """The table that ingest() fills: known keys stay as they are, or with merge take each newer value that is not null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    return DeltaTable(spark, root, schema, keys, order, "coalesce" if merge else "ignore", slices=slices)


def ingest(source: DataFrame, root: str, keys: list[str], checkpoint: str, merge: bool = False, order: tuple[str, ...] = (), compact_every: int = 10, slices: int = 16):
    """Adds each batch of a stream to a delta table. A batch is named by its checkpoint and number, so one that is replayed
    is not added again; after every ``compact_every`` batches the slices that these have touched are compacted."""
    stream_name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, number: int) -> None:
        t = delta_table(batch.sparkSession, root, source, keys, merge, order, slices)
        t.append(batch, f"{stream_name}-{number}")
        if (number + 1) % compact_every == 0:
            t.compact()

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique(source: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Drops repeated keys within the watermark."""
    return source.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts(source: DataFrame, at: str, width: str, slide: str | None = None, by: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and sums per event-time window: an extension beyond the batch engine."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return source.withWatermark(at, late).groupBy(w, *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(source: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return source.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
