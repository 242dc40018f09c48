"""What the operators share: shared folders, shipping code, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: White space and words as all operators here take them.
SPACE = r"[\x20\x09-\x0D]"
#: Texts of characters on whose classes, case and composition all Unicode versions and libraries agree.
PLAIN = re.compile(r"[\x00-\x1B\x20-\x7E\u00A1-\u024F\u2010-\u2027\u20AC]*").fullmatch
#: A group of more than one HOT_SHARE-th of all rows, and of HOT_ROWS, is broadcast; at most HOT_SHARE groups can be that large.
HOT_SHARE, HOT_ROWS = 512, 100


#: ``spark.checkpoint.dir``, or where that is unset under a local master (tests) a local folder.
shared_root = session.shared_root


def shared_dir(spark: SparkSession) -> str:
    """A new folder below shared_root()."""
    return f"{shared_root(spark)}/sidewind-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> int:
    """Removes the folders that these operators left below shared_root(); returns how many.

    For the end of an application: results that are still lazy read from these folders.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    mine = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("sidewind-")]
    return sum(bool(fs.delete(p, True)) for p in mine)


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet to a new shared folder and reads it back.

    This cuts the lineage: losing an executor afterwards costs no recomputation, and readers do
    not depend on any machine's local disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: narrow rows travel in large batches, a few megabytes of text in one.
BATCH_ROWS, BATCH_BYTES = 20_000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once per application, and bounds Arrow
    batches by bytes, since a row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    session.ship(spark)


def tidied(run):
    """run(batches), which gives memory back to the system at the end of its task: Python workers live on, and what one
    stage held would count beside what the next one holds."""

    def out(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return out


def partitions(spark: SparkSession, rows: int = 0, most: int = 2_000_000) -> int:
    """Shuffle partitions: as many as the session sets, or more where a task would get over ``most`` of so many rows (or bytes)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and no other letters. Most texts need only the fast lower(); the few with
    letters that it maps into or out of ASCII, or to another length, take translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


#: Rows of a few narrow columns that are broadcast at most; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def broadcast_within(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, counted; its columns should be few and narrow."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to their group, groups unique by key with ``size`` rows each.

    A group of more than ``total / HOT_SHARE`` rows is hot; there are at most HOT_SHARE of these,
    so they are broadcast. A row of a hot group, or with a null in its key, gets a key of its own in
    the shuffled join, which matches nothing and so spreads over all tasks.
    """
    rest = [c for c in groups.columns if c not in key]
    least = max(total // HOT_SHARE, HOT_ROWS)
    hot = groups.where(F.col(size) > least).select(*[F.col(c).alias(f"_h_{c}") for c in groups.columns])
    cold = groups.where(F.col(size) <= least).select(
        F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key]).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in rest]
    )
    on = [F.col(c) == F.col(f"_h_{c}") for c in key]
    found = F.col(f"_h_{key[0]}").isNotNull()
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    out = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_k",
        F.when(found | null, F.concat(F.lit("\u0002"), F.monotonically_increasing_id().cast("string"))).otherwise(
            F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key])
        ),
    )
    out = out.join(cold, "_k", "left")
    return out.select(*rows.columns, *[F.when(found, F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in rest])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows
    with the logarithm of the size. Each round is a few joins and aggregations with map-side
    combination; the round's edges are written to the shared folder, so lineage stays short, and
    only a count and a checksum reach the driver. A hub's rows take its least neighbour by broadcast.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def with_least(df: DataFrame, rows: int) -> DataFrame:
        """Adds m, the least v of each u. Only where some u has a large share of the rows, it is joined as a hot group."""
        least = df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if (least.agg(F.max("n")).first()[0] or 0) > max(rows // HOT_SHARE, HOT_ROWS):
            return join_groups(df, least, ["u"], "n", rows)
        return df.join(least.drop("n"), "u")

    now = sign(e)
    if not now[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = (
            with_least(large, 2 * now[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, "edges")
        before, now = now, sign(e)
        if before == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
