"""Upserts and other DML as rewrites to a new version.

Parquet has no MERGE: each operator returns the table's next state as a DataFrame, and write_version
stores it beside the old one, which stays readable until the pointer moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: list[str], order: tuple[str, ...] = (), first: bool = False, each: tuple[str, ...] | None = None) -> DataFrame:
    """Of rows with one key the last by ``order`` (with first: the first), equal ones by a hash of the row: one
    aggregation with map-side combination. With ``each``, every column has its last value that is not null
    (for the columns in ``each`` not empty either)."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order], F.xxhash64(*rows.columns).alias("_hash"))
    if not rest:
        return rows.select(*keys).distinct()
    if each is not None:
        value = lambda c: F.nullif(F.col(c), F.lit("")) if c in each else F.col(c)
        return rows.groupBy(*keys).agg(*[F.max_by(value(c), F.when(value(c).isNotNull(), at)).alias(c) for c in rest]).select(*rows.columns)
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), at).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace rows of old with their keys, nulls included. Of a key's rows in new the last by ``order`` counts."""
    return _merge(old, one_per_key(new, keys, order), keys, lambda c, n, o: F.when(F.col("_new"), n).otherwise(o))


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], empty_is_null: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """As upsert, but a null (for the named columns also an empty string) leaves the old value. A key's rows in new apply one after another, by ``order``."""
    return _merge(old, one_per_key(new, keys, order, each=empty_is_null), keys, lambda c, n, o: F.coalesce(n, o))


def _merge(old, new, keys, rule):
    """Keys are matched null-safe: rows whose key is null are one key, as an aggregation groups them."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_new"))
    same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(n[f"_k_{k}"]) for k in keys])
    both = old.withColumn("_old", F.lit(True)).join(n, same, "full_outer").withColumn("_new", F.coalesce("_new", F.lit(False)))
    key = lambda k: F.when(F.col("_old"), F.col(k)).otherwise(F.col(f"_k_{k}"))
    return both.select(*[(key(k) if k in keys else rule(k, F.col(f"_n_{k}"), F.col(k))).alias(k) for k in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rows of new whose keys are not there yet, of a key's rows the first by ``order``; applying it twice changes nothing."""
    one = one_per_key(new, keys, order, first=True)
    same = reduce(lambda a, b: a & b, [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in keys])
    return old.unionByName(one.join(old.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), same, "left_anti"))


def update_where(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    c = changes.select(*keys, *[F.col(x).alias(f"_n_{x}") for x in columns], F.lit(True).alias("_hit"))
    out = df.join(c, keys, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in df.columns])


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def append(master: DataFrame, rows: DataFrame) -> DataFrame:
    return master.unionByName(rows, allowMissingColumns=True)


def unmatched(rows: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(matched.select(*keys), keys, "left_anti")


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def write_version(df: DataFrame, root: str, version: int, sort: list[str] | None = None) -> str:
    """Writes a new version folder; readers of older ones are not disturbed. Sorted files prune by statistics."""
    path = f"{root.rstrip('/')}/v={version:06d}"
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("errorifexists").parquet(path)
    return path


def versions(spark: SparkSession, root: str, torn: bool = False) -> list[int]:
    """Complete versions under root, by the store's own listing; torn: also those whose writer died."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and (torn or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))))


def next_version(spark: SparkSession, root: str) -> int:
    """A number that no version has, so a retry never meets what a dead writer left."""
    return max(versions(spark, root, torn=True), default=0) + 1


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/v={versions(spark, root)[-1]:06d}")
