"""Ordered scans that a hot key cannot hold up: running sums, as-of values and positions over chunks.

A window over a key is one task's work, however long the key's timeline is. Here rows are dealt by
ranges of (key, order), as evenly as the order allows, and each range is a chunk: a hot key's timeline is
cut in as many time chunks as it has shares of rows. Within a chunk an ordinary window scans; each chunk
adds up to one total per key; the totals of the few keys that go over a chunk's edge, at most two a
chunk, are scanned in turn, and what earlier chunks add up to, the carry, is broadcast to the rows of later
ones. The chunks are written to the shared folder, since sampled ranges differ from run to run.

Nulls come first in every order, keys and times alike. Rows that are alike in key and order are ordered
by a hash of the whole row, so only rows that are alike in all columns may stand in either order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """df with ``_chunk`` (ranges of keys and order, numbered in order) and ``_tie`` (a hash of the row), written and read back."""
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    ranged = tied.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*keys, *order, "_tie"]])
    return written(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_c_{k}"]) for k in keys], F.lit(True))


def _carried(rows: DataFrame, totals: DataFrame, keys: list[str], carries: dict[str, Column]) -> DataFrame:
    """rows with the carries that totals(_chunk, keys, ...) give; a carry is a column over the chunks before, by key.

    Only keys of more than one chunk are joined: at most two for each chunk.
    """
    by = Window.partitionBy(*keys)
    more = totals.withColumn("_chunks", F.count("*").over(by)).where("_chunks > 1")
    scanned = more.select(F.col("_chunk").alias("_c_chunk"), *[F.col(k).alias(f"_c_{k}") for k in keys], *[c.alias(name) for name, c in carries.items()])
    joined = rows.join(F.broadcast(scanned), (rows["_chunk"] == scanned["_c_chunk"]) & _same(rows, scanned, keys), "left")
    return joined.drop("_c_chunk", *[f"_c_{k}" for k in keys])


def scan(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, chunks: int | None = None) -> DataFrame:
    """df with running sums of the rows before each row (0 at the first), and last values that are not null at or before it.

    sums and lasts are columns over df by the name of the result.
    """
    sums, lasts = sums or {}, lasts or {}
    added = {f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()}
    rows = chunked(df.withColumns(added), keys, order, chunks)
    at = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    inside = Window.partitionBy("_chunk", *keys).orderBy(*at)
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[F.col(c) for c in [*order, "_tie"]])
    totals = rows.groupBy("_chunk", *keys).agg(
        *([F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums] + [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in lasts] or [F.count("*").alias("_n")])
    )
    carries = {f"_cs_{n}": F.sum(f"_s_{n}").over(earlier) for n in sums} | {f"_cl_{n}": F.last(f"_l_{n}", ignorenulls=True).over(earlier) for n in lasts}
    out = _carried(rows, totals, keys, carries) if carries else rows
    zero = F.lit(0)
    found = {n: F.coalesce(F.sum(f"_s_{n}").over(before), zero) + F.coalesce(f"_cs_{n}", zero) for n in sums}
    found |= {n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(upto), F.col(f"_cl_{n}")) for n in lasts}
    return out.select(*df.columns, *[c.alias(n) for n, c in found.items()])


def positions(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """df with ``pos`` (0, 1, ... in order, nulls first) and ``n``, the number of rows: counts of the chunks, added up, and numbers within."""
    rows = chunked(df, [], order, chunks)
    sizes = rows.groupBy("_chunk").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each chunk, so one task and a broadcast are enough.
    offsets = sizes.select(F.col("_chunk").alias("_c"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("_chunk").orderBy(*[F.col(c).asc_nulls_first() for c in [*order, "_tie"]])
    out = rows.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(offsets), F.col("_chunk") == F.col("_c"))
    return out.select(*df.columns, (F.col("_before") + F.col("_in")).alias("pos"), "n")


def asof_scan(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str], tie: list[str] | None = None, chunks: int | None = None) -> DataFrame:
    """As ``joins.asof``, for keys of any share of the rows: each left row with the newest right row of its keys at or before its time.

    Rows without a time find nothing, and are found by none; nor do rows with a null in their keys.
    """
    tie = tie or []
    typed = right.select(F.struct(*[F.col(c) for c in columns], F.col(right_at).alias("_right_at")).alias("pay"), F.struct(*tie, F.lit(0).alias("_")).alias("tie"))
    names = [f"_k{i}" for i in range(len(keys))]
    l = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(typed.schema["tie"].dataType).alias("_order"), F.lit(None).cast(typed.schema["pay"].dataType).alias("_pay"), F.struct(*left.columns).alias("_row"))
    r = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.struct(*tie, F.lit(0).alias("_")).alias("_order"), F.struct(*[F.col(c) for c in columns], F.col(right_at).alias("_right_at")).alias("_pay"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"))
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in [*names, "_t"]])
    rows = l.unionByName(r.where(whole))
    out = scan(rows, names, ["_t", "_side", "_order"], lasts={"_found": F.col("_pay")}, chunks=chunks).where("_side = 1")
    ok = lambda c: F.when(whole, F.col(f"_found.{c}"))
    return out.select("_row.*", *[ok(c).alias(c) for c in columns], ok("_right_at").alias(f"{right_at}_found"))
