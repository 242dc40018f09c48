"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of
the text's word shingles, repeats included. To link fingerprints within ``radius`` bits they are
cut into ``radius // 2 + 1`` segments, so of two that link, one segment differs by at most one bit.
For each of the 64 bit positions the index holds the segment around it with that bit deleted; two
segments within one bit share such a variant. An equality join on (position, variant) brings the
candidates together, and each is verified by its full distance.

Size: fingerprints are made distinct before they are indexed, so copies cost one row. A pair is
looked at in one variant only: that of the first segment within one bit, at the bit that differs
(or the segment's first bit). Buckets emit links that join something new in their task, never all
pairs. Segment values of more than ``max(20000, n / 10000)`` fingerprints, of which there are at most
30,000 per segment, are hot: the buckets they reach are dealt out in block pairs over many tasks.

Defined results: null text is the empty text; no words give fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; a null id takes its group's component and is
the smallest only where there is no other; an empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_groups, materialize, partitions, ship

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Pairs of a large bucket that are compared at once; near pairs a row from which it is searched.
BLOCK, DENSE = 1 << 17, 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the lower-cased text's word shingles in order; fewer words make one shingle."""
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 bits, lowest first, for each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(counts: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Packs rows of 64 bit counts to fingerprints: bits set in over half of n."""
    return np.packbits(counts * 2 > n, axis=-1, bitorder="little").view("<u8")[..., 0]


def of_hashes(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        total += bits_of(hashes[i : i + 65536]).sum(0, dtype=np.int64)
    return int(majority(total, len(hashes)))


def fingerprint(text: bytes, words: int = 4) -> int:
    return of_hashes(shingle_hashes(text, words))


def stir(x: np.ndarray) -> np.ndarray:
    """Another hash of each hash (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprints(words: int, second: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.zeros((2, len(texts)), np.uint64)
            for i, t in enumerate(texts):
                hashes = shingle_hashes(t or b"", words)
                fps[0, i] = of_hashes(hashes)
                if second:
                    fps[1, i] = of_hashes(stir(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(f.view(np.int64), pa.int64()) for f in fps)], ("doc_id", "fp", "more"))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, second: bool = False) -> DataFrame:
    """(doc_id, fp, more) of each row of docs; more is a second fingerprint by other hashes, if asked for, else 0."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _fingerprints(words, second), "doc_id long, fp long, more long"
    )


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: two fingerprints within radius agree in one but for a bit."""
    n = radius // 2 + 1
    width, more = divmod(64, n)
    out, at = [], 0
    for k in range(n):
        w = width + (k >= n - more)
        out.append((at, w))
        at += w
    return out


def _variant(fp: Column, pos: Column, cut: list[tuple[int, int]]) -> Column:
    """Position and the segment around it without that bit, in one long."""
    key = None
    for lo, w in cut:
        seg = F.shiftrightunsigned(fp, lo).bitwiseAND((1 << w) - 1)
        key_s = F.call_function("shiftright", F.call_function("shiftright", seg, pos - lo), F.lit(1))
        high = F.call_function("shiftleft", key_s, pos - lo)
        low = seg.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), pos - lo) - 1)
        value = high.bitwiseOR(low)
        here = (pos >= lo) & (pos < lo + w)
        key = F.when(here, value) if key is None else key.when(here, value)
    return F.shiftleft(pos.cast("long"), 48).bitwiseOR(key)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union-find over the fingerprints that a task has linked; says which links join something new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        r = a
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(a, a)) != r:
            up[a] = r
            a = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(radius: int, more_radius: int, sure: int):
    cut = segments(sure)

    def canonical(x: np.ndarray) -> np.ndarray:
        """For differences x: the position of the one variant in which the pair is looked at."""
        out = np.full(len(x), -1)
        for lo, w in reversed(cut):
            seg = (x >> np.uint64(lo)) & np.uint64((1 << w) - 1)
            few = popcount(seg) <= 1
            bit = np.where(seg == 0, 0, np.log2(np.maximum(seg, 1).astype(float)).astype(int))
            out = np.where(few, lo + bit, out)
        return out

    def run(batches):
        """Rows come sorted by (key, cell): runs of equal ones are buckets, or a pair of blocks of a hot one."""
        forest, rest = _Forest(), None

        def edges(a, b):
            new = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
            if new:
                x, y = zip(*new, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ("a", "b"))

        def small(run_of, pos, fp, more, node):
            """Neighbours at growing offsets, all buckets at once."""
            live, k = np.arange(len(fp)), 0
            while True:
                k += 1
                live = live[live + k < len(fp)]
                live = live[run_of[live] == run_of[live + k]]
                if not len(live):
                    return
                x = fp[live] ^ fp[live + k]
                near = np.flatnonzero(popcount(x) <= radius)
                near = near[canonical(x[near]) == pos[live[near]]]
                if more_radius < 64:
                    near = near[popcount(more[live[near]] ^ more[live[near] + k]) <= more_radius]
                if len(near) and (out := edges(node[live[near]], node[live[near] + k])):
                    yield out

        def large(pos, fp, more, node):
            """All pairs in blocks of rows; a bucket with many near pairs is searched instead."""
            size, first, second, held, at = len(fp), [], [], 0, 0
            while at < size:
                rows = max(1, BLOCK // (size - at))
                x = fp[at : at + rows, None] ^ fp[None, at:]
                i, j = np.divmod(np.flatnonzero(popcount(x) <= radius), size - at)
                once = i < j
                first.append(i[once] + at)
                second.append(j[once] + at)
                held += len(first[-1])
                if held > DENSE * size:
                    yield from search(pos, fp, more, node)
                    return
                at += rows
            i, j = np.concatenate(first), np.concatenate(second)
            ok = canonical(fp[i] ^ fp[j]) == pos
            if more_radius < 64:
                ok &= popcount(more[i] ^ more[j]) <= more_radius
            if ok.any() and (out := edges(node[i[ok]], node[j[ok]])):
                yield out

        def search(pos, fp, more, node):
            """A breadth-first search: what is reached leaves the rest, so no pairs are listed."""
            left = np.arange(len(fp))
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    one = queue.pop()
                    x = fp[left] ^ fp[one]
                    near = popcount(x) <= radius
                    near[near] = canonical(x[near]) == pos
                    if more_radius < 64:
                        near[near] = popcount(more[left[near]] ^ more[one]) <= more_radius
                    got = left[near]
                    if len(got):
                        if out := edges(np.full(len(got), node[one]), node[got]):
                            yield out
                        queue += got.tolist()
                        left = left[~near]

        def work(key, cell, *rest):
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            length = np.diff(np.r_[start, len(key)])
            pos = key >> 48
            run_of = np.repeat(np.arange(len(start)), length)
            few = np.repeat(length <= 48, length)
            yield from small(run_of[few], pos[few], *(r[few] for r in rest))
            for s, n in zip(start[length > 48].tolist(), length[length > 48].tolist(), strict=True):
                yield from large(pos[s], *(r[s : s + n] for r in rest))

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "cell", "fp", "more", "node")]
            now[2:4] = (x.view(np.uint64) for x in now[2:4])
            if rest:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            key, cell = now[:2]
            if len(key) and (key[0], cell[0]) == (key[-1], cell[-1]):
                rest = now
                continue
            last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1
            yield from work(*[x[:last] for x in now])
            rest = [x[last:] for x in now]
        if rest and len(rest[0]):
            yield from work(*rest)

    return run


def links(fps: DataFrame, radius: int, n: int, more_radius: int = 64, sure: int | None = None) -> DataFrame:
    """(a, b): links between nodes fps(fp, more, node) that connect all that are within both radii.

    sure: the radius that the segments are cut for, ``radius`` itself if not given. With a smaller one
    buckets are smaller, and beyond it only pairs link that still have a segment within one bit.
    """
    spark = fps.sparkSession
    sure = radius if sure is None else sure
    cut = segments(sure)
    most = max(20_000, n // 10_000)
    hot: dict[tuple[int, int], int] = {}
    if n > most:
        values = F.array(*[F.struct(F.lit(k).alias("s"), F.shiftrightunsigned("fp", lo).bitwiseAND((1 << w) - 1).alias("v")) for k, (lo, w) in enumerate(cut)])
        for r in fps.select(F.explode(values).alias("x")).groupBy("x.s", "x.v").count().where(F.col("count") > most).collect():
            hot[r.s, r.v] = r["count"]
    rows = fps.select("fp", "more", "node", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    rows = rows.select(_variant(F.col("fp"), F.col("pos"), cut).alias("key"), "fp", "more", "node")
    if hot:
        # The blocks of a hot bucket: each pair of blocks meets in one cell.
        blocks: dict[int, int] = {}
        for (s, v), count in hot.items():
            lo, w = cut[s]
            for i in range(w):
                key = ((lo + i) << 48) | ((v >> (i + 1)) << i) | (v & ((1 << i) - 1))
                blocks[key] = blocks.get(key, 0) + count
        sizes = spark.createDataFrame([(k, -(-c // most) + 1) for k, c in blocks.items()], "key long, blocks int")
        rows = rows.join(F.broadcast(sizes), "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * 65536 + F.greatest(j, own))
        rows = rows.select("key", "fp", "more", "node", F.explode(F.coalesce(cells, F.array(F.lit(0)))).alias("cell"))
    else:
        rows = rows.select("key", "fp", "more", "node", F.lit(0).alias("cell"))
    return (
        rows.repartition(partitions(spark, 64 * n), "key", "cell")
        .sortWithinPartitions("key", "cell")
        .mapInArrow(_links(radius, more_radius, sure), "a long, b long")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, more_radius: int | None = None, sure: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id, linked), one row per row of docs: component_id is the smallest doc_id reachable by links.

    more_radius: links must also hold for a second fingerprint by other hashes, within so many bits.
    At a wide radius chance brings unrelated fingerprints together; chance in both does not.
    sure: links up to this radius are all found; see links().
    """
    spark = docs.sparkSession
    digest = materialize(fingerprints(docs, id_col, text_col, words, more_radius is not None), "fingerprints")
    total = digest.count()
    node = F.col("fp") if more_radius is None else F.xxhash64("fp", "more")
    digest = digest.withColumn("node", node)
    groups = materialize(digest.groupBy("fp", "more", "node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    edges = links(groups, radius, groups.count(), 64 if more_radius is None else more_radius, sure)
    labels = connected_components(edges).withColumnRenamed("component", "label")
    # Groups within links: the smallest id of the whole component.
    linked = groups.select("node", "first", "n").join(labels, "node")
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "label").select("node", "n", "component_id", F.lit(True).alias("linked"))
    copies = groups.join(labels, "node", "left_anti").where("n > 1").select("node", "n", F.col("first").alias("component_id"), F.lit(False).alias("linked"))
    members = materialize(linked.unionByName(copies), "members")
    out = join_groups(digest, members, ["node"], "n", total)
    return out.select(
        "doc_id", "fp", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("linked", F.lit(False)).alias("linked"),
    )


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
