"""Joins that Spark has no syntax for, and lookups."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship
from . import alike

#: Bytes up to which a dimension is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """Marks df for broadcast if the optimizer's size estimate is within BROADCAST_BYTES."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """Each left row with the columns of the newest right row of its keys at or before its time; null if there is none.

    Both sides are stacked and the newest right value is carried forward: one exchange and one sort,
    whatever the number of columns. Of right rows with one time the last by ``tie`` counts.
    """
    tie = tie or []
    payload = F.struct(*[F.col(c) for c in columns], F.col(right_at).alias("_right_at"))
    l_cols = left.columns
    l = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_row"))
    none = F.lit(None).cast(T.StructType([*[f for f in right.select(*columns).schema], T.StructField("_right_at", right.schema[right_at].dataType)]))
    order = F.struct(*tie) if tie else F.struct(F.lit(0).alias("_"))
    l = l.withColumn("_tie", F.lit(None).cast(right.select(order.alias("x")).schema["x"].dataType)).withColumn("_pay", none)
    r = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_at).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*l_cols).alias("x")).schema["x"].dataType).alias("_row"),
        order.alias("_tie"), payload.alias("_pay"),
    )
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_found", F.last("_pay", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns], F.col("_found._right_at").alias(f"{right_at}_found"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by one aggregation with map-side combination."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def within_days(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, days: int = 1) -> DataFrame:
    """Rows whose dates are at most ``days`` apart, as an equality join on each near day."""
    near = left.withColumn("_near", F.explode(F.sequence(F.date_sub(left_date, days), F.date_add(left_date, days))))
    return near.join(right.withColumn("_near", F.col(right_date)), [*keys, "_near"]).drop("_near")


def pair_lookup(left: DataFrame, odds: DataFrame, a: str, b: str) -> DataFrame:
    """odds(a, b, odds_a, odds_b) by either order of the pair, values swapped where it is reversed."""
    both = odds.select("a", "b", "odds_a", "odds_b").unionByName(odds.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("odds_b").alias("odds_a"), F.col("odds_a").alias("odds_b")))
    return left.join(both.withColumnsRenamed({"a": a, "b": b}), [a, b], "left")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings, in Arrow batches. Block first."""
    ship(SparkSession.active())
    return _ratio(a, b)


def fuzzy_pairs(left: DataFrame, right: DataFrame, block: list[str], least: float = 0.85) -> DataFrame:
    """left(id, a, b) with right(rid, a, b): the first match in which both names reach ``least``.

    Only rows that agree on the block columns are compared, and of equal names only one (``alike``). Straight order
    comes before reversed, then rid; ``reversed`` says that the payload is to be swapped.
    """
    l = left.select("id", alike.key_of(left, block).alias("_k"), alike.names_of("a", "b").alias("_names")).where("_k IS NOT NULL")
    r = right.select("rid", alike.key_of(right, block).alias("_k"), alike.names_of("a", "b").alias("_names")).where("_k IS NOT NULL")
    r = r.groupBy("_k", "_names").agg(F.min(F.struct("rid")).alias("_pick")).withColumn("_pick", F.col("_pick.rid"))
    found = alike.match(l.select("_k", "_names").distinct(), r, alike.first_in(least), F.asc_nulls_first("_pick"))
    best = l.join(found, ["_k", "_names"]).groupBy("id").agg(F.min(F.struct("reversed", "_pick", (-F.col("score")).alias("_low"))).alias("_best"))
    return best.select("id", F.col("_best._pick").alias("rid"), F.col("_best.reversed").alias("reversed"), (-F.col("_best._low")).alias("score"))


def best_match(left: DataFrame, right: DataFrame, block: list[str], floors: tuple[float, float] = (0.75, 0.6), least_sum: float = 1.0) -> DataFrame:
    """left(id, a, b) with right(rid, a, b) of its block: the pair with the highest sum of ratios above the floors.

    Of equal names only one is compared, and few pairs in full (``alike``).
    """
    l = left.select("id", alike.key_of(left, block).alias("_k"), alike.names_of("a", "b").alias("_names")).where("_k IS NOT NULL")
    r = right.select("rid", alike.key_of(right, block).alias("_k"), alike.names_of("a", "b").alias("_names")).where("_k IS NOT NULL")
    r = r.groupBy("_k", "_names").agg(F.min("rid").alias("_pick"))
    found = alike.match(l.select("_k", "_names").distinct(), r, alike.best_in(floors, least_sum), F.asc_nulls_last("_pick"))
    return l.join(found, ["_k", "_names"]).groupBy("id").agg(F.max_by("_pick", F.struct(F.col("score"), -F.col("_pick"))).alias("rid"), F.max("score").alias("score"))


def bag_prefix(name: Column, cutoff: float) -> Column:
    """The letters by which names of a ratio of at least ``cutoff`` are sure to meet.

    The ratio of two names is at most twice their common letters over all letters, counted with
    repeats. So of a name of n letters at least n * cutoff / (2 - cutoff) must be common, and in any
    one order of numbered letters ("s2" is the second s) the first n - common + 1 of both names share one.
    """
    letters = F.split(F.coalesce(name, F.lit("")), "")
    letters = F.filter(letters, lambda x: x != "")
    numbered = F.transform(letters, lambda x, i: F.struct(-F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)), x))
    n = F.size(letters)
    need = F.ceil(n * F.lit(cutoff / (2 - cutoff)) - 1e-9).cast("int")
    return F.slice(F.array_sort(numbered), 1, F.greatest(n - need + 1, F.lit(0)))


def closest(names: DataFrame, candidates: DataFrame, block: Column | None = None, candidate_block: Column | None = None, cutoff: float = 0.8) -> DataFrame:
    """names(name) with the most similar of candidates(candidate), in its block if blocks are given, if it reaches the cutoff.

    Without blocks every pair that can reach the cutoff is compared: they meet by bag_prefix().
    """
    if block is None:
        l = names.select("name", F.explode(bag_prefix(F.col("name"), cutoff)).alias("_b"))
        pairs = l.join(candidates.select("candidate", F.explode(bag_prefix(F.col("candidate"), cutoff)).alias("_b")), "_b").select("name", "candidate").distinct()
        scored = pairs.withColumn("score", similarity(F.col("name"), F.col("candidate"))).where(F.col("score") >= cutoff)
    else:
        l, r = names.where("name IS NOT NULL").withColumn("_b", block), candidates.withColumn("_b", candidate_block)
        l = l.select(alike.key_of(l, ["_b"]).alias("_k"), alike.names_of("name").alias("_names")).where("_k IS NOT NULL").distinct()
        r = r.select("candidate", alike.key_of(r, ["_b"]).alias("_k"), alike.names_of("candidate").alias("_names")).where("_k IS NOT NULL").groupBy("_k", "_names").agg(F.max("candidate").alias("_pick"))
        scored = alike.match(l, r, alike.best_in((cutoff, cutoff), -1.0), F.desc_nulls_last("_pick")).select(F.col("_names")[0].alias("name"), F.col("_pick").alias("candidate"), "score")
    best = scored.groupBy("name").agg(F.max_by("candidate", F.struct("score", "candidate")).alias("match"), F.max("score").alias("score"))
    return names.join(best, "name", "left")


def rank_in_class(asked: DataFrame, ranks: DataFrame, key: str, cls: str, order: list[str]) -> DataFrame:
    """asked with the newest rank of its key, of the rows whose class holds the asked one (case and hyphens aside); where no
    row does, or no class is asked for, of all rows. By one aggregation: rows that fit come before all others."""
    plain = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit(" "))
    a = asked.select(F.monotonically_increasing_id().alias("_id"), "*")
    r = ranks.select(F.col(key).alias("_key"), F.col(cls).alias("_cls"), F.col("rank").alias("_rank"), F.struct(*order).alias("_at"))
    fits = F.coalesce(F.contains(plain(F.col("_cls")), plain(F.col(cls))), F.lit(False))
    out = a.join(r, F.col(key) == F.col("_key"), "left")
    rest = [c for c in asked.columns if c != "rank"]
    return out.groupBy("_id", *rest).agg(F.max_by("_rank", F.struct(fits, F.col("_at"))).alias("rank")).drop("_id")


def with_alias(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Replaces names by aliases(alias, name), a dimension with unique aliases."""
    dim = small(aliases.select(F.col("alias").alias("_a"), F.col("name").alias("_to")))
    return df.join(dim, F.col(name) == F.col("_a"), "left").withColumn(name, F.coalesce("_to", name)).drop("_a", "_to")


def names_of(df: DataFrame, dim: DataFrame, ids: dict[str, str], key: str, name: str) -> DataFrame:
    """Adds a name for each id column, by one dimension."""
    for id_col, out in ids.items():
        d = small(dim.select(F.col(key).alias(f"_{id_col}"), F.col(name).alias(out)))
        df = df.join(d, F.col(id_col) == F.col(f"_{id_col}"), "left").drop(f"_{id_col}")
    return df


def exists(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def missing(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def head_to_head(bouts: DataFrame, a, b) -> DataFrame:
    """All bouts of a pair, in either corner, newest first."""
    pair = F.struct(F.least("r_id", "b_id"), F.greatest("r_id", "b_id"))
    return bouts.where(pair == F.struct(F.lit(min(a, b)), F.lit(max(a, b)))).orderBy(F.desc("ts"), F.desc("bout_id"))


def first_rows(side_rows: DataFrame) -> DataFrame:
    """Rows at each participant's earliest date."""
    w = Window.partitionBy("participant_id")
    return side_rows.withColumn("_first", F.min("date").over(w)).where("date = _first").drop("_first")
