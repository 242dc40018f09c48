"""Keyed permutations of positions, and exact order statistics: what a global shuffle or sort is otherwise needed for.

A permutation of 0 .. n - 1 is a Feistel network over the next power of four, walked until it is inside
again: any row finds the row whose value it gets from its own position, with nothing stored and no sort.
A quantile is found by counting: rows fall into bins between the least and greatest value, the bin
that holds the wanted rank is cut anew, and so on until few rows are left in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rounds of the network; fixed numbers of its round function and of its keys.
ROUNDS, MIX, PRIME, STRETCH = 4, 40503, 1048573, 48271
KEY_SEED, KEY_REPEAT, KEY_ROUND = 7919, 104729, 1299709
#: Bins of a pass; rows of a bin from which its values are looked at one by one.
BINS, FEW = 1024, 10_000


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def keys_of(seed: int, repeat: int) -> list[int]:
    return [(seed * KEY_SEED + repeat * KEY_REPEAT + r * KEY_ROUND) % PRIME for r in range(ROUNDS)]


def permuted(pos: np.ndarray, n: int, seed: int, repeat: int = 0) -> np.ndarray:
    """Where each position goes; for 0 <= pos < n all different, and within the same range."""
    k = half_bits(n)
    mask = (1 << k) - 1
    out, todo = pos.astype(np.int64), np.arange(len(pos))
    while len(todo):
        left, right = out[todo] >> k, out[todo] & mask
        for key in keys_of(seed, repeat):
            left, right = right, left ^ ((((right * MIX + key) % PRIME) * STRETCH // 16) & mask)
        out[todo] = (left << k) | right
        todo = todo[out[todo] >= n]
    return out


def donors(pos: Column, n: int, seed: int, repeats: int) -> Column:
    """An array with the donor of a position for each repeat."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(p: pd.Series) -> pd.Series:
        every = np.stack([permuted(p.to_numpy(), n, seed, r) for r in range(repeats)], 1)
        return pd.Series(list(every))

    return of(pos.cast("long"))


def with_donors(rows: DataFrame, n: int, columns: list[str], seed: int = 42, repeats: int = 10) -> DataFrame:
    """rows(pos, ...) once for each repeat, with ``repeat``, ``donor`` and the donor's columns as _d_<column>, by one join."""
    ship(rows.sparkSession)
    asked = rows.withColumn("_donors", donors(F.col("pos"), n, seed, repeats)).select("*", F.posexplode("_donors").alias("repeat", "donor")).drop("_donors")
    return asked.join(rows.select(F.col("pos").alias("donor"), *[F.col(c).alias(f"_d_{c}") for c in columns]), "donor")


@dataclass
class _Search:
    rank: int
    low: float
    high: float
    below: int


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = BINS, few: int = FEW) -> list[float]:
    """The values at these ranks (0 is the least) of the values that are neither null nor NaN; ranks must lie within them.

    Each pass is one aggregation to at most ``bins`` rows for each rank; the last one is over few rows.
    """
    v = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v")).where("v IS NOT NULL")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_ = [_Search(r, low, high, 0) for r in sorted(set(ranks))]
    while open_:
        done = [s for s in open_ if s.low == s.high]
        found |= {s.rank: s.low for s in done}
        open_ = [s for s in open_ if s.low != s.high]
        spans = sorted({(s.low, s.high) for s in open_})
        if not spans:
            break
        # The spans of ranks that are still together are one; others do not overlap.
        span, bin_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(spans):
            here = (F.col("v") >= a) & (F.col("v") <= b)
            width = b / 2 - a / 2
            at = F.floor((F.col("v") / 2 - a / 2) / F.lit(width) * bins) if width > 0 else F.when(F.col("v") > a, bins).otherwise(0)
            span, bin_ = F.when(here, i).otherwise(span), F.when(here, F.least(at, F.lit(bins - 1)).cast("int")).otherwise(bin_)
        cells: dict[int, list] = {}
        for r in v.select("v", span.alias("span"), bin_.alias("bin")).where("span IS NOT NULL").groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("span", "bin").collect():
            cells.setdefault(r.span, []).append(r)
        small: list[tuple[_Search, int]] = []
        for s in open_:
            below = s.below
            for r in cells[spans.index((s.low, s.high))]:
                if s.rank < below + r.n:
                    if (r.a, r.b) == (s.low, s.high) or r.n <= few:
                        small.append((s, r.n))
                    s.low, s.high, s.below = r.a, r.b, below
                    break
                below += r.n
        for s, _ in small:
            # Few rows, or as few values as floating point numbers between the bounds can tell apart.
            at = s.below
            for r in v.where((F.col("v") >= s.low) & (F.col("v") <= s.high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect():
                at += r.n
                if s.rank < at:
                    s.low = s.high = r.v
                    break
    return [found[r] for r in ranks]


def exact_quantile(df: DataFrame, column: str, share: float, bins: int = BINS, few: int = FEW) -> float | None:
    """The quantile with linear interpolation between neighbours, as SQL's median for 0.5; null without values."""
    n = df.select(F.count(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")))).first()[0]
    if not n:
        return None
    at = share * (n - 1)
    a, b = order_statistics(df, column, [int(at), min(int(at) + 1, n - 1)], bins, few)
    return a + (b - a) * (at - int(at))
