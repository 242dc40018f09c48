"""Streams as queries: each runs over what is there, to the end, and its output is read back.

Checkpoints and outputs lie below spark.checkpoint.dir; only where that is unset (local tests) below a
local folder. Event-time windows and sessions are extensions of the engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root
from ..streaming import ingest
from ..streaming.career import career
from .bouts import side_rows


def folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as a stream; a table that is a single file is given by its folder and name."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(out: DataFrame, to: str, mode: str = "append") -> DataFrame:
    spark = out.sparkSession
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{to}/checkpoint").option("path", f"{to}/out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/out")


def _complete(out: DataFrame, to: str) -> DataFrame:
    """Writes an aggregation's full result at each trigger, and reads the last."""
    spark = out.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/out")

    q = out.writeStream.foreachBatch(put).option("checkpointLocation", f"{to}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/out")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.counts(_events(spark, sf_dir), "ts", "1 day", by=["event_type"])
    return _complete(out, folder(spark)).select(F.col("window.start").cast("string").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.sessions(_events(spark, sf_dir), "ts", "user_id", "6 hours")
    return _complete(out, folder(spark)).select("user_id", F.col("session_window.start").cast("string").alias("start"), F.col("session_window.end").cast("string").alias("end"), "n")


def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return _finish(ingest.unique(e.unionByName(e), ["event_id"], "ts").select("event_id", "user_id"), folder(spark))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingests twice into one table: the second run finds every key there."""
    to = folder(spark)
    rows = _events(spark, sf_dir).select("event_id", "user_id", "value")
    for k in (1, 2):
        ingest.ingest(rows, f"{to}/table", ["event_id"], f"{to}/checkpoint{k}").awaitTermination()
    return ingest.delta_table(spark, f"{to}/table", rows, ["event_id"]).read()


def written_in_order(rows: DataFrame, path: str, parts: int, files: int = 4) -> None:
    """Writes rows(participant_id, ts, ...) as ``parts`` appends in time order, each with a participant's rows in one file.

    A file stream takes older files first, so however many of them a batch takes, no participant's later rows come
    before earlier ones.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [None, *(rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)])).first()[0] or []), None]
    for low, high in zip(cuts, cuts[1:]):
        part = rows if low is None else rows.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.repartition(files, "participant_id").write.mode("append").parquet(path)


def stream_career(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches or more in time order, so that states go from one to the next."""
    to = folder(spark)
    rows = side_rows(spark, sf_dir).select("participant_id", "bout_id", "ts", "is_win", "is_loss", "landed", "attempted", "seconds")
    written_in_order(rows, f"{to}/sides", 3)
    source = ingest.stream(spark, f"{to}/sides", rows.schema, files_per_trigger=4)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _finish(career(source), to).select("bout_id", "participant_id", "wins", "losses", "win_streak", "loss_streak", "longest", "landed")
