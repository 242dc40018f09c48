"""Source divergence audit: how the terms of each source differ from other sources of its language.

Prices: a group (lang, source), and each lang as a whole, gives every kept term the price
``p = 1 + (10**9 * (count + 5)) div (N + 5 * V)``. The distance of two groups is the sum of
``|p - q|`` over all kept terms, most of which occur in neither group. It is had by inclusion and
exclusion over the groups' supports:

* constants: a term in neither costs ``|z - z'|``, z a group's price of no occurrence;
* histograms: per group, how many terms have each count. Laid out with the other groups' z in one order
  of prices, running sums give the cost of all its terms as if the other group had none of them;
* postings: for terms that both have, a join of a term's posting list with itself takes both one-sided
  costs back and adds the true one. It is done list by list inside tasks, which hand on sums for pairs
  of groups.

Size: texts are counted in Arrow batches, so what is shuffled are terms of batches, not words; a
posting list has at most one entry per source of its lang, and the result itself has a row for each
pair of these. Sums of pairs are kept for at most ``CELLS`` pairs at a time, longer lists go in tiles.

Defined results: null text, lang and source are ''; a group without terms has its rows; a lang without
kept terms has distances of 0 and no term rows; repeated rows and ids count as documents of their own; an
empty table gives an empty result; only the columns text, lang and source are read. Prices are exact for
counts beyond 64 bits.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_within, materialize, ship

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Terms that a task counts before it hands them on; pairs whose sums it holds; entries of a tile of a long list.
HELD, CELLS, TILE = 200_000, 1 << 22, 1 << 10
SMOOTH, UNIT = 5, 1_000_000_000


def _counted(held: dict) -> pa.RecordBatch:
    names = ("lang", "source", "term", "n", "docs")
    rows = [(lang, source, t, n, d) for (lang, source), (tf, df) in held.items() for t, n, d in [(None, 0, 0), *((t, n, df[t]) for t, n in tf.items())]]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
    arrays[2] = arrays[2].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names)


def _count_terms(batches):
    held, size = {}, 0
    for batch in batches:
        texts, langs, sources = batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for i, group in enumerate(zip(langs, sources, strict=True)):
            tf, df = held.setdefault(group, (Counter(), Counter()))
            found = Counter(TERM.findall(texts[i].as_py().translate(LOWER)))
            size -= len(tf)
            tf.update(found)
            df.update(found.keys())
            size += len(tf)
            if size > HELD:
                yield _counted(held)
                held, size = {}, 0
    if held:
        yield _counted(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; term is null in one row of each group."""
    ship(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = texts.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """(lang, term, n, list): kept terms, with (source, n) of the sources that hold them; and a row of term null with all sources."""
    lists = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("list"))
    return lists.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs")


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + (10**9 * (count + 5)) div (total + 5 * kept), exact; null where nothing is kept."""
    wide = lambda c: c.cast("decimal(28,0)")
    part = F.nullif(wide(total) + wide(kept) * SMOOTH, F.lit(0).cast("decimal(28,0)"))
    return F.lit(1).cast("long") + F.call_function("div", (wide(count) + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), part)


def groups_of(lists: DataFrame) -> DataFrame:
    """(lang, source, total, support, kept, lang_total, zero) of each group."""
    each = lists.select("lang", "term", F.inline("list")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"))
    langs = lists.where("term IS NOT NULL").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    both = each.join(broadcast_within(langs), "lang", "left").fillna(0, ["kept", "lang_total"])
    return both.withColumn("zero", price(F.lit(0), F.col("total"), F.col("kept")))


def one_sided(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, cost): the cost of all terms of a as if b had none of them.

    counts(lang, source, p, terms) is the groups' histogram by price. Other groups' prices of no
    occurrence stand among a's prices in order; running counts and sums before and after give the cost.
    """
    a = groups.select("lang", F.col("source").alias("a"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("p"))
    asked = a.join(broadcast_within(b), "lang").where("a <> b")
    rows = counts.select("lang", F.col("source").alias("a"), F.lit(None).cast("string").alias("b"), "p", "terms").unionByName(asked.withColumn("terms", F.lit(0).cast("long")))
    group = Window.partitionBy("lang", "a")
    upto = group.orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    n, s = F.sum("terms"), F.sum(F.col("terms") * F.col("p"))
    rows = rows.select("lang", "a", "b", "p", n.over(upto).alias("n1"), s.over(upto).alias("s1"), n.over(group).alias("n"), s.over(group).alias("s"))
    return rows.where("b IS NOT NULL").selectExpr("lang", "a", "b", "(p * n1 - s1) + ((s - s1) - p * (n - n1)) AS cost")


class _Sums:
    """Sums for pairs of sources of a lang, in a matrix that grows."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.sums = np.zeros((16, 16, 2), np.int64)

    def places(self, sources: list[str]) -> np.ndarray:
        out = np.array([self.at.setdefault(s, len(self.at)) for s in sources])
        if len(self.at) > len(self.sums):
            size = 1 << (len(self.at) - 1).bit_length()
            wide = np.zeros((size, size, 2), np.int64)
            wide[: len(self.sums), : len(self.sums)] = self.sums
            self.sums = wide
        return out

    def rows(self, lang: str) -> pa.RecordBatch:
        names = pa.array(list(self.at), pa.string())
        i, j = np.nonzero(self.sums[..., 1])
        arrays = [pa.array([lang] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(self.sums[i, j, 0]), pa.array(self.sums[i, j, 1])]
        return pa.RecordBatch.from_arrays(arrays, ("lang", "a", "b", "fix", "common"))


def _correct(batches):
    held: dict[str, _Sums] = {}
    for batch in batches:
        for lang, entries in zip(batch.column("lang").to_pylist(), batch.column("list"), strict=True):
            flat = entries.values
            sources, p, z = flat.field("source").to_pylist(), flat.field("p").to_numpy(), flat.field("zero").to_numpy()
            for x in range(0, len(p), TILE):
                for y in range(0, len(p), TILE):
                    if sum(len(s.sums) ** 2 for s in held.values()) > CELLS:
                        yield from (s.rows(k) for k, s in held.items())
                        held = {}
                    sums = held.setdefault(lang, _Sums())
                    a, b = slice(x, x + TILE), slice(y, y + TILE)
                    i, j = sums.places(sources[a]), sums.places(sources[b])
                    pa_, za, pb, zb = p[a][:, None], z[a][:, None], p[b][None], z[b][None]
                    at = np.ix_(i, j)
                    sums.sums[(*at, 0)] += abs(pa_ - pb) - abs(pa_ - zb) - abs(za - pb) + abs(za - zb)
                    sums.sums[(*at, 1)] += 1
    yield from (s.rows(k) for k, s in held.items())


def overlaps(priced: DataFrame) -> DataFrame:
    """(lang, a, b, fix): what the terms that both have change, from priced(lang, list of (source, p, zero))."""
    return priced.mapInArrow(_correct, "lang string, a string, b string, fix long, common long").groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix")).where("a <> b")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.where(F.col("rank") <= most)


def divergence(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks a lang's other sources by distance, part ``term``
    the terms that a source uses more than its lang, by the difference."""
    lists = materialize(postings(docs, least_docs), "postings")
    groups = materialize(groups_of(lists), "groups")
    flat = lists.where("term IS NOT NULL").select("lang", "term", F.col("n").alias("lang_n"), F.inline("list"))
    rows = flat.join(broadcast_within(groups.drop("support")), ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("kept")))
    rows = materialize(rows.select("lang", "source", "term", "p", "zero", price(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "priced")

    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    cost = one_sided(rows.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), groups)
    both = cost.unionByName(cost.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    # A posting list's entries are priced rows of one term again; it is no longer than its lang has sources.
    fix = overlaps(rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("list")).select("lang", "list"))
    sums = both.unionByName(fix.select("lang", "a", "b", F.col("fix").alias("cost"))).groupBy("lang", "a", "b").agg(F.sum("cost").alias("cost"))
    side = lambda k: groups.select("lang", F.col("source").alias(k), F.col("support").alias(f"n_{k}"), F.col("zero").alias(f"z_{k}"), *(["kept"] if k == "a" else []))
    pairs = sums.join(broadcast_within(side("a")), ["lang", "a"]).join(broadcast_within(side("b")), ["lang", "b"])
    value = F.coalesce(F.col("cost") + (F.col("kept") - F.col("n_a") - F.col("n_b")) * F.abs(F.col("z_a") - F.col("z_b")), F.lit(0)).cast("long")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return _ranked(pairs).unionByName(_ranked(terms, top_terms))
