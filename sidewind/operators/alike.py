"""The most similar names, or the first that are similar enough, within blocks: exact, with few full comparisons.

The Ratcliff-Obershelp ratio is twice the matched letters over all letters. What it matches is a common
subsequence, so the longest one bounds it, and the letters that both names have, order aside, bound that.
Both bounds are had for a name against a whole chunk of others at once; the ratio itself is taken only
of pairs whose bound can still change the answer, best bounds first.

Only different names of a block are compared, each with the row that is to be preferred among equals. A
block is cut into chunks of names, and each pair of chunks is a group of its own: a task holds one such group
at a time, however large the block is. The work of a block still grows with the square of its different names.
"""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Different names of a block in a chunk of either side.
LEFT, RIGHT = 512, 8192
#: Bins of letters; where a chunk has more letters some share one, and the bound is looser.
BINS = 64
#: Longest names for the second bound: of the asked name, one bit a letter, and of the others.
LONG, LONG_OTHER = 64, 256
#: From this length on difflib leaves popular letters out, and equal names may differ.
POPULAR = 200


def ratio(x: str, y: str) -> float:
    return 1.0 if x == y and len(y) < POPULAR else difflib.SequenceMatcher(None, x, y).ratio()


class _Names:
    """A chunk of names by letters, for bounds of the ratio with another name."""

    def __init__(self, names: list[str]):
        self.names, n = names, len(names)
        self.sizes = np.array([len(s) for s in names], np.int64)
        letters, at = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True)
        self.rank = {chr(c): i for i, c in enumerate(letters.tolist())}
        self.longest = int(self.sizes.max(initial=0))
        bins = min(BINS, len(letters))
        row = np.repeat(np.arange(n), self.sizes)
        kind = np.uint8 if self.longest < 256 else np.int64
        self.counts = np.bincount((at % max(bins, 1)) * n + row, minlength=bins * n).astype(kind).reshape(bins, n)
        self.by_place = None
        if self.longest <= LONG_OTHER:
            # Letters by place; past a name's end a letter that no name has.
            self.by_place = np.full((self.longest, n), len(letters), np.int64)
            self.by_place[np.arange(len(row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes), row] = at

    def _ratio(self, common: np.ndarray, x: str, sizes: np.ndarray) -> np.ndarray:
        if not x:
            return (sizes == 0).astype(float)
        return 2.0 * common / (sizes + len(x))

    def bound(self, x: str) -> np.ndarray:
        """Of all names, by the letters in common."""
        bins: Counter = Counter()
        for c, k in Counter(x).items():
            if c in self.rank:
                bins[self.rank[c] % len(self.counts)] += k
        common = np.zeros(len(self.names), self.counts.dtype)
        for b, k in bins.items():
            common += np.minimum(self.counts[b], self.counts.dtype.type(min(k, self.longest)))
        return self._ratio(common.astype(np.int64), x, self.sizes)

    def tighter(self, x: str, which: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Of some names, by the longest common subsequence, whose row of lengths is the bits of one word."""
        if self.by_place is None or len(x) > LONG or not x:
            return bound
        masks = np.zeros(len(self.rank) + 1, np.uint64)
        for i, c in enumerate(x):
            if c in self.rank:
                masks[self.rank[c]] |= np.uint64(1 << i)
        rows = np.full(len(which), np.uint64(2**64 - 1))
        for place in self.by_place[: int(self.sizes[which].max(initial=0))]:
            met = rows & masks[place[which]]
            rows = (rows + met) | (rows - met)
        common = np.bitwise_count(~rows & np.uint64((1 << len(x)) - 1)).astype(np.int64)
        return self._ratio(common, x, self.sizes[which])


def _portions(which: np.ndarray, first: int = 16, most: int = 4096):
    """which in parts that become longer, since the first ones mostly decide."""
    at = 0
    while at < len(which):
        yield which[at : at + first]
        at, first = at + first, min(4 * first, most)


def best_in(floors: tuple[float, float], least_sum: float):
    """For each name the other of the highest sum of ratios; of equal ones the first. With several columns the higher and the
    lower ratio of a pair must reach the floors, and their sum must be above least_sum."""

    def better(columns: list[_Names], xs: list[str], j: int, best: float, at: int) -> tuple[float, int]:
        rs = [ratio(x, c.names[j]) for c, x in zip(columns, xs, strict=True)]
        s = sum(rs)
        won = max(rs) >= floors[0] and min(rs) >= floors[1] and s > least_sum and (s > best or (s == best and j < at))
        return (s, j) if won else (best, at)

    def find(asked: list[list[str]], others: list[list[str]]):
        columns = [_Names(list(c)) for c in zip(*others, strict=True)]
        fits = lambda rs: (np.maximum.reduce(rs) >= floors[0]) & (np.minimum.reduce(rs) >= floors[1]) & (sum(rs) > least_sum)
        for i, xs in enumerate(asked):
            loose = [c.bound(x) for c, x in zip(columns, xs, strict=True)]
            can, total = np.flatnonzero(fits(loose)), sum(loose)
            if not len(can):
                continue
            top = can[np.argmax(total[can])]
            best, at = better(columns, xs, int(top), -1.0, -1)
            can = can[(total[can] >= best) & (can != top)]
            can = can[np.argsort(-total[can], kind="stable")]
            for part in _portions(can):
                if total[part[0]] < best:
                    break
                tight = [c.tighter(x, part, b[part]) for c, x, b in zip(columns, xs, loose, strict=True)]
                keep, upper = fits(tight), sum(tight)
                for k in np.lexsort((part, -upper)):
                    j = int(part[k])
                    if upper[k] < best:
                        break
                    if keep[k] and (upper[k] > best or j < at):
                        best, at = better(columns, xs, j, best, at)
            if at >= 0:
                yield i, at, best, False

    return find


def first_in(least: float):
    """For each pair of names the first other pair of which both names reach ``least``, in straight order, else in reversed order."""

    def find(asked: list[list[str]], others: list[list[str]]):
        columns = [_Names(list(c)) for c in zip(*others, strict=True)]

        def first(xs: list[str], order: list[_Names]) -> tuple[int, float] | None:
            loose = [c.bound(x) for c, x in zip(order, xs, strict=True)]
            for part in _portions(np.flatnonzero(np.minimum.reduce(loose) >= least)):
                tight = np.minimum.reduce([c.tighter(x, part, b[part]) for c, x, b in zip(order, xs, loose, strict=True)])
                for j in part[tight >= least].tolist():
                    low = both(xs, order, j)
                    if low >= least:
                        return j, low
            return None

        both = lambda xs, order, j: min(ratio(x, c.names[j]) for c, x in zip(order, xs, strict=True))
        for i, xs in enumerate(asked):
            if (hit := first(xs, columns)) is not None:
                yield i, hit[0], max(hit[1], both(xs, columns[::-1], hit[0])), False
            elif (hit := first(xs, columns[::-1])) is not None:
                yield i, *hit, True

    return find


def _runs(batches):
    """The rows of one group after another; groups come whole and in order."""
    held, key = [], None
    for b in batches:
        keys, at = b.column("_g").to_pylist(), 0
        for i, k in enumerate(keys):
            if k != key:
                if i > at:
                    held.append(b.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, key, at = [], k, i
        if len(keys) > at:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matches(find):
    def run(batches):
        for group in _runs(batches):
            names, n = group.column("_names").to_pylist(), sum(group.column("_left").to_pylist())
            found = list(find(names[len(names) - n :], names[: len(names) - n]))
            if not found:
                continue
            asked, other, score, turned = (list(c) for c in zip(*found, strict=True))
            mine = group.take(pa.array([i + len(names) - n for i in asked], pa.int64()))
            pick = group.take(pa.array(other, pa.int64())).column("_pick")
            out = pa.table([mine.column("_k"), mine.column("_names"), pick, pa.array(score, pa.float64()), pa.array(turned, pa.bool_())], ["_k", "_names", "_pick", "score", "reversed"])
            yield from out.to_batches()

    return run


def key_of(df: DataFrame, block: list[str]) -> Column:
    """The block as one value, null where a column is null, with numbers that a join takes as equal made the same."""
    kinds = {f.name: f.dataType for f in df.schema}
    plain = lambda c: (F.col(c) + F.lit(0.0)).cast("string") if isinstance(kinds[c], T.FloatType | T.DoubleType) else F.col(c)
    known = F.lit(True)
    for c in block:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.struct(*[plain(c).alias(f"k{i}") for i, c in enumerate(block)]))


def names_of(*columns: str) -> Column:
    """Names that are not known count as empty."""
    return F.array(*[F.coalesce(c, F.lit("")) for c in columns])


def match(left: DataFrame, right: DataFrame, find, first: Column) -> DataFrame:
    """left(_k, _names) with right(_k, _names, _pick) of the same block, by ``find``: (_k, _names, _pick, score, reversed), one row
    for each name and chunk of the others in which it finds one.

    Rows of a side must differ by block and names. ``first`` orders _pick: the first of equal rows is preferred.
    """
    spark = left.sparkSession
    ship(spark)
    chunks = lambda df, out, most: df.groupBy("_k").agg(F.ceil(F.count("*") / most).cast("int").alias(out))
    cut = chunks(left, "_nl", LEFT).join(chunks(right, "_nr", RIGHT), "_k")
    own, each = (lambda n: F.pmod(F.xxhash64("_names"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    l = left.join(cut, "_k").select("*", own("_nl").alias("_l")).select("*", each("_nr").alias("_r")).withColumns({"_left": F.lit(1), "_pick": F.lit(None).cast(right.schema["_pick"].dataType)})
    r = right.join(cut, "_k").select("*", own("_nr").alias("_r")).select("*", each("_nl").alias("_l")).withColumn("_left", F.lit(0))
    rows = l.unionByName(r).select(F.struct("_k", "_l", "_r").alias("_g"), "_k", "_names", "_left", "_pick")
    # Few bytes are much work here, so the number of tasks is set, not left to sizes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_k", "_names", "_pick")}
    return rows.repartition(tasks, "_g").sortWithinPartitions("_g", "_left", first).mapInArrow(_matches(find), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", score double, reversed boolean")
