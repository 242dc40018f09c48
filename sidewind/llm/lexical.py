"""Ranked lexical search: dual-sorted wavelet trees, one for each shard of documents.

A shard's posting lists stand behind one another, each ordered by impact, highest first. A wavelet tree
over this sequence of document numbers keeps that order in all its nodes: a node covers a range of
documents, a term's postings in it are one interval, and its first posting has the term's highest impact
there. The sum over the query's terms of weight times that impact so bounds the score of every document
below the node, and at a leaf it is the score. Best-first search goes down into the nodes with the
highest bounds, for all terms at once, and ends when no bound reaches the k-th score found: the top k is
exact, ties included. Nodes are taken from the queue some dozens at a time, so that numpy works on them
together; this changes what is looked at, not what is found.

``build_index`` writes the shards (document ids, terms, bit planes, impacts) to the shared folder;
``search`` reads only them. A task goes on from shard to shard with the best scores so far, and hands on
k rows for each query.

Size: a shard holds about ``SHARD_BYTES`` of text, or one longer document, so memory does not grow with
the table. Queries are taken in blocks of at most ``BLOCK_TERMS`` terms, each with one pass over the
index; a block and its terms' document counts are all that the driver holds.

Defined results: null or empty texts and items have no terms, and no rows; equal scores are ordered by
doc_id, nulls last; repeated rows are documents of their own, and repeated items are answered each;
empty tables give an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, ship

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text and documents of a shard; terms of a block of queries; nodes that are opened at once.
SHARD_BYTES, SHARD_DOCS, BLOCK_TERMS, WIDTH = 8 << 20, 1 << 16, 200_000, 48
#: Row groups of the index stay small, since a row is a shard.
FILES = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "2", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
SCHEMA = "docs array<long>, terms binary, stops binary, height int, planes binary, impacts binary"


def terms_of(text: str | bytes | None) -> list[bytes]:
    text = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(text.translate(LOWER))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + 75 * n * n_docs // n_terms


class Shard:
    """Collects documents and lays out their wavelet tree."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms_of(text)
        if found:
            self.rows.append((doc_id, len(found), Counter(found)))
            self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.rows) >= SHARD_DOCS

    def laid_out(self, n_docs: int, n_terms: int) -> dict:
        rows = sorted(self.rows, key=lambda r: (r[0] is None, r[0] or 0))
        places: dict[bytes, int] = {}
        term = np.fromiter((places.setdefault(t, len(places)) for r in rows for t in r[2]), np.uint64)
        tf = np.fromiter((c for r in rows for c in r[2].values()), np.int64, len(term))
        sizes = [len(r[2]) for r in rows]
        doc = np.repeat(np.arange(len(rows), dtype=np.uint64), sizes)
        norm = np.repeat(np.array([length_norm(r[1], n_docs, n_terms) for r in rows], np.int64), sizes)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm)
        # Term, then impact downwards (it is below 2**20), then document, in one number.
        key = (term << np.uint64(36)) | ((np.uint64(0xFFFFF) - impact.astype(np.uint64)) << np.uint64(16)) | doc
        key.sort()
        impact = (np.uint64(0xFFFFF) - ((key >> np.uint64(16)) & np.uint64(0xFFFFF))).astype(np.int32)
        now, height, planes = (key & np.uint64(0xFFFF)).astype(np.int32), max(1, (len(rows) - 1).bit_length()), []
        for level in range(height - 1, -1, -1):
            bit = (now >> level) & 1
            planes.append(np.packbits(bit.astype(np.uint8)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        stops = np.cumsum(np.bincount(term.astype(np.int64), minlength=len(places)))
        return {
            "docs": [r[0] for r in rows], "terms": b" ".join(places), "stops": stops.astype("<i4").tobytes(), "height": height,
            "planes": np.concatenate(planes).tobytes(), "impacts": impact.astype("<i4").tobytes(),
        }


class Tree:
    """A shard's wavelet tree, opened: ranks of zeros and first impacts at every level."""

    def __init__(self, row: dict):
        self.docs, self.height = row["docs"], row["height"]
        self.stops = np.frombuffer(row["stops"], "<i4")
        impact = np.frombuffer(row["impacts"], "<i4")
        self.size = len(impact)
        bits = np.unpackbits(np.frombuffer(row["planes"], np.uint8).reshape(self.height, -1), axis=1, count=self.size)
        self.ranks = np.zeros((self.height, self.size + 1), np.int32)
        np.cumsum(1 - bits, axis=1, dtype=np.int32, out=self.ranks[:, 1:])
        self.zeros = self.ranks[:, -1].astype(np.int64)
        self.impacts = np.zeros((self.height + 1, self.size + 1), np.int32)
        self.impacts[0, :-1] = impact
        for level in range(self.height):
            one = bits[level].view(bool)
            z = self.zeros[level]
            self.impacts[level + 1, :z] = self.impacts[level, :-1][~one]
            self.impacts[level + 1, z:-1] = self.impacts[level, :-1][one]

    def top(self, places: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, document's number) of the k best of at least ``least``, best first, by best-first search."""
        left = np.where(places > 0, self.stops[places - 1], 0).astype(np.int64)[None]
        right = self.stops[places].astype(np.int64)[None]
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.impacts[0, left] * weights).sum(1)
        scores, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = self.size + 1
        ranks, impacts = self.ranks.ravel(), self.impacts.ravel()
        while len(bound):
            rest = np.zeros(0, np.int64)
            if len(bound) > WIDTH:
                order = np.argpartition(-bound, WIDTH)
                now, rest = order[:WIDTH], order[WIDTH:]
            else:
                now = slice(None)
            a, b, at, name = left[now], right[now], level[now], prefix[now]
            base = (at * row)[:, None]
            a0, b0 = ranks[base + a].astype(np.int64), ranks[base + b].astype(np.int64)
            z = self.zeros[at][:, None]
            a, b = np.concatenate([a0, z + a - a0]), np.concatenate([b0, z + b - b0])
            at, name = np.concatenate([at, at]) + 1, np.concatenate([2 * name, 2 * name + 1])
            best = (np.where(b > a, impacts[(at * row)[:, None] + a], 0) * weights).sum(1)
            leaf = (at == self.height) & (best >= least)
            if leaf.any():
                scores, numbers = np.concatenate([scores, best[leaf]]), np.concatenate([numbers, name[leaf]])
                first = np.lexsort((numbers, -scores))[:k]
                scores, numbers = scores[first], numbers[first]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
            new = (at < self.height) & (best >= least)
            rest = rest[bound[rest] >= least]
            left, right, level, prefix, bound = (np.concatenate([x[rest], y[new]]) for x, y in ((left, a), (right, b), (level, at), (prefix, name), (bound, best)))
        return list(zip(scores.tolist(), numbers.tolist(), strict=True))


def _build(n_docs: int, n_terms: int):
    schema = pa.schema([("docs", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("terms", "stops")), ("height", pa.int32()), *((c, pa.binary()) for c in ("planes", "impacts"))])

    def run(batches):
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                shard.add(doc_id, text.as_py() or b"")
                if shard.full():
                    yield pa.RecordBatch.from_pylist([shard.laid_out(n_docs, n_terms)], schema)
                    shard = Shard()
        if shard.rows:
            yield pa.RecordBatch.from_pylist([shard.laid_out(n_docs, n_terms)], schema)

    return run


@dataclass
class Index:
    shards: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Counts the terms, then writes the shards' trees."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = F.coalesce(F.regexp_count("text", F.lit(TERM_SQL)), F.lit(0)).alias("n")
    n_docs, n_terms = texts.select(n).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    path = f"{shared_dir(spark)}/trees"
    texts.mapInArrow(_build(n_docs, n_terms), SCHEMA).write.options(**FILES).parquet(path)
    return Index(spark.read.schema(SCHEMA).parquet(path), n_docs, n_terms)


def _doc_counts(wanted: frozenset):
    def run(batches):
        total = Counter()
        for batch in batches:
            for terms, stops in zip(batch.column("terms").to_pylist(), batch.column("stops").to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(stops, "<i4"), prepend=0).tolist()
                total.update({t: n for t, n in zip(terms.split(b" "), sizes, strict=True) if t in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ("term", "df"))

    return run


def weights(index: Index, terms: frozenset) -> dict[bytes, int]:
    """Weight of each of these terms that the index holds, if it is above 0."""
    found = index.shards.select("terms", "stops").mapInArrow(_doc_counts(terms), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    w = {bytes(r.term): math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in found.collect()}
    return {t: x for t, x in w.items() if x > 0}


def _search(block: list[tuple[int | None, Counter]], weight: dict[bytes, int], k: int):
    asked = [[(t, weight[t] * n) for t, n in c.items() if t in weight] for _, c in block]

    def run(batches):
        best: list[list[tuple]] = [[] for _ in block]
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                place = {t: i for i, t in enumerate(row["terms"].split(b" ")) if t in weight}
                for q, terms in enumerate(asked):
                    here = [(place[t], w) for t, w in terms if t in place]
                    if not here:
                        continue
                    least = -best[q][-1][0] if len(best[q]) == k else 1
                    at, w = np.array(here, np.int64).T
                    new = [(-s, tree.docs[d] is None, tree.docs[d] or 0) for s, d in tree.top(at, w, k, least)]
                    if new:
                        best[q] = sorted([*best[q], *new])[:k]
        rows = [(q, block[q][0], None if null else d, -s) for q, b in enumerate(best) for s, null, d in b]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ("q", "item_id", "doc_id", "score"))

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        terms = Counter(terms_of(r[1]))
        block.append((r[0], terms))
        size += len(terms)
        if size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    spark = items.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/found"
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(items, id_col, text_col):
        weight = weights(index, frozenset(t for _, c in block for t in c))
        found = index.shards.mapInArrow(_search(block, weight, k), "q long, item_id long, doc_id long, score long")
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
