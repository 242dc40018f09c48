"""Versions with an index: per file the range of a key and a Bloom filter, so that a lookup opens few files.

The filters are a table too, (file, word, bits), built by one aggregation over hashed bit positions and sorted
by word. A lookup asks it for the words of a value's positions, keeps the files that have all of those
bits, and of these the ones whose range holds the value: what is opened can hold the key, with a few
false ones among them, and never misses it. Rows are laid out by ranges of the key, so ranges overlap little.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dml import versions

#: Bits for each row of a file's filter, and positions of a value.
BITS, HASHES = 10, 5


def _positions(key: Column, bits: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key.cast("string")), bits) for i in range(HASHES)])


def write_indexed(df: DataFrame, root: str, version: int, key: str, files: int | None = None) -> str:
    """Writes a version laid out by ranges of key, then its index; the index's mark of success makes it a version."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/v={version:06d}"
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    rows = spark.read.parquet(path).select(name, F.col(key).alias("key"))
    ranges = rows.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("nulls"))
    # One length for all filters, so that a value's positions are the same in each.
    most = ranges.agg(F.max("n")).first()[0] or 1
    bits = 64 * -(-BITS * most // 64)
    ranges.withColumn("bits", F.lit(bits).cast("long")).coalesce(1).write.parquet(f"{root.rstrip('/')}/index/v={version:06d}/ranges")
    at = rows.where("key IS NOT NULL").select("file", F.explode(_positions(F.col("key"), F.lit(bits).cast("long"))).alias("at"))
    words = at.groupBy("file", F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    words.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{root.rstrip('/')}/index/v={version:06d}/words")
    return path


def files_of(spark: SparkSession, root: str, key: Any, version: int | None = None) -> list[str]:
    """The files of a version (the newest) that can hold the key. A null key is in the files that have nulls."""
    v = version or versions(spark, root)[-1]
    at = f"{root.rstrip('/')}/index/v={v:06d}"
    ranges = spark.read.parquet(f"{at}/ranges")
    if key is None:
        return sorted(r.file for r in ranges.where("nulls > 0").select("file").collect())
    first = ranges.first()
    if first is None:
        return []
    value = F.lit(key).cast(ranges.schema["low"].dataType)
    wanted = spark.range(1).select(F.explode(_positions(value, F.lit(first.bits))).alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).collect()
    asked = spark.createDataFrame([(r.word, r.bit) for r in wanted], "word long, bit long")
    # The words are few, so they also prune the scan of the filters, which is sorted by them.
    found = spark.read.parquet(f"{at}/words").where(F.col("word").isin([r.word for r in wanted])).join(F.broadcast(asked), "word").where("bits & bit = bit")
    good = found.groupBy("file").count().where(F.col("count") == len(wanted)).select("file")
    return sorted(r.file for r in ranges.where((F.col("low") <= value) & (F.col("high") >= value)).join(good, "file", "left_semi").select("file").collect())


def point(spark: SparkSession, root: str, column: str, key: Any, version: int | None = None) -> DataFrame:
    """The rows of a version whose column is the key, from the files that can hold it."""
    v = version or versions(spark, root)[-1]
    path = f"{root.rstrip('/')}/v={v:06d}"
    schema = spark.read.parquet(path).schema
    files = [f"{path}/{f}" for f in files_of(spark, root, key, v)]
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(column).eqNullSafe(F.lit(key)))
