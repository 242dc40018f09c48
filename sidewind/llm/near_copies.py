"""SimHash near-dedup by similarity: deletion-variant signatures propose, exact similarity decides.

Two texts are near copies if the sets of their word shingles (five words, lower-cased A-Z) have a
Jaccard similarity of ``least`` (0.8) or more. Fingerprints have three words of 64 bits, each the
majority of the distinct shingles' hashes (XXH64, seed 42, and two hashes of it). At similarity 0.8
two of them differ in about 15 % of the bits, whatever their length, so a guarantee by pigeonhole
would need segments of less than ten bits. Instead each word has SEGMENTS segments of WIDTH bits, and
two texts meet if any of the twelve differs by at most one bit: the index holds the one-wildcard
variants of each segment, joined by equality. By the binomial law a pair at similarity 0.8 meets with
probability 0.994 and one at 0.85 with 0.9997; the README has the measured recall. Of what meets, pairs
within RADIUS of all 192 bits are candidates (at 0.8 the mean is 29 and the deviation 5, by chance 96
and 7), and these are verified by the exact similarity of their sets.

Size: texts with equal shingle sets are one entry from the start, so copies cost one row. A task puts
out one link for each entry, to the least that its buckets connect it with, never all pairs; segment values of more than
``max(20000, n / 10000)`` entries are hot, and their buckets are dealt out in block pairs. Only texts
that have a candidate are read again. They are verified within the groups that candidates connect,
in cells of one or two blocks of at most CELL_ROWS texts and CELL_BYTES bytes, by a breadth-first
search that compares what is not yet reached. So every two texts of a group meet in some cell, and
what a cell does not link has been compared.

Defined results: null text is the empty text; texts without words are copies of each other; fewer
words than a shingle make one shingle; a null id is kept only where its group has no other; of
repeated rows one is kept; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, broadcast_within, connected_components, join_groups, materialize, partitions, ship, tidied
from .simhash_dedup import BLOCK, DENSE, _Forest, of_hashes, popcount, shingle_hashes, stir

WORDS, LEAST = 5, 0.8
#: Segments of each fingerprint word and their bits; bits that candidates may differ by.
SEGMENTS, WIDTH, RADIUS = 4, 14, 50
CUT = [(w, 16 * k) for w in range(3) for k in range(SEGMENTS)]
FP = ("a", "b", "c")
#: Texts and bytes of a block that is verified; index rows that are compared at once.
CELL_ROWS, CELL_BYTES, ROWS = 1000, 32 << 20, 1 << 16


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def prints_of(hashes: np.ndarray) -> tuple[int, int, int]:
    """The three words of a set's fingerprint."""
    second = stir(hashes)
    return of_hashes(hashes), of_hashes(second), of_hashes(stir(second + np.uint64(1)))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty sets is 1."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _digest(words: int):
    names = ("doc_id", "text_hash", "sig", "size", *FP, "node")

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                have = shingle_set(t or b"", words)
                out.append((xxhash.xxh64_intdigest(have.tobytes(), 1), len(t or b""), *prints_of(have)))
            found = [np.array(x, np.uint64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64)] * 5
            found.append(node_of(*found[2:]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x.view(np.int64)) for x in found)], names)

    return run


def _variant(pos: Column) -> Column:
    """For position 0 to len(CUT) * WIDTH - 1: the position, and its segment without that bit, in one long."""
    key, bit = None, F.pmod(pos, F.lit(WIDTH))
    low_bits = F.call_function("shiftleft", F.lit(1).cast("long"), bit) - 1
    for k, (w, lo) in enumerate(CUT):
        seg = F.shiftrightunsigned(FP[w], lo).bitwiseAND((1 << WIDTH) - 1)
        high = F.shiftright(seg, 1).bitwiseAND(F.bitwise_not(low_bits))
        here = pos < (k + 1) * WIDTH
        key = F.when(here, high.bitwiseOR(seg.bitwiseAND(low_bits))) if key is None else key.when(here, high.bitwiseOR(seg.bitwiseAND(low_bits)))
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(key)


def node_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return stir(a ^ stir(b ^ stir(c)))


def _stars(forest: _Forest):
    """A link from each entry to the least of its component in this task.

    A large group meets in most tasks' buckets, each time as another part of it with another least entry;
    the least of all that a task connects is more often the same.
    """
    linked = list(forest.up)
    for at in range(0, len(linked), BATCH_ROWS):
        a = linked[at : at + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([forest.root(x) for x in a], pa.int64())], ("a", "b"))


def _candidates(radius: int):
    """Rows come sorted by (key, cell): runs of equal ones are buckets, or a pair of blocks of a hot one."""

    def run(batches):
        forest = _Forest()

        def unite(node, pairs):
            """Joins the nodes of each bucket's pairs. Pairs are places in ``node``, and a place is in one bucket only."""
            up: dict[int, int] = {}

            def root(p):
                while (q := up.get(p, p)) != p:
                    up[p] = up.get(q, q)
                    p = q
                return p

            for i, j in pairs:
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root(p), root(q)
                    if p != q:
                        p, q = (p, q) if node[p] < node[q] else (q, p)
                        up[q] = p
            for p in list(up):
                if (r := root(p)) != p:
                    forest.join(int(node[p]), int(node[r]))

        def few(run_of, node, *fp):
            """Neighbours at growing offsets, all buckets at once."""
            live, k, pairs = np.arange(len(node)), 0, []
            while len(live):
                k += 1
                live = live[live + k < len(node)]
                live = live[run_of[live] == run_of[live + k]]
                near = live[sum(popcount(w[live] ^ w[live + k]).astype(np.int16) for w in fp) <= radius] if len(live) else live
                pairs.append((near, near + k))
            unite(node, pairs)

        def many(node, *fp):
            """All pairs in blocks of rows; a bucket with many near pairs is searched instead."""
            size, at, pairs, held = len(node), 0, [], 0
            while at < size and held <= DENSE * size:
                rows = max(1, BLOCK // (size - at))
                near = sum(popcount(w[at : at + rows, None] ^ w[None, at:]).astype(np.int16) for w in fp) <= radius
                i, j = np.divmod(np.flatnonzero(near), size - at)
                pairs.append((i[i < j] + at, j[i < j] + at))
                held += len(pairs[-1][0])
                at += rows
            if at < size:
                pairs, left = [], np.arange(size)
                while len(left):
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        one = queue.pop()
                        near = sum(popcount(w[left] ^ w[one]).astype(np.int16) for w in fp) <= radius
                        got, left = left[near], left[~near]
                        pairs.append((np.full(len(got), one), got))
                        queue += got.tolist()
            unite(node, pairs)

        def work(key, cell, *fp):
            fp = [w.view(np.uint64) for w in fp]
            node = node_of(*fp).view(np.int64)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            length = np.diff(np.r_[start, len(key)])
            small = np.repeat(length <= 48, length)
            few(np.repeat(np.arange(len(start)), length)[small], node[small], *(w[small] for w in fp))
            for s, n in zip(start[length > 48].tolist(), length[length > 48].tolist(), strict=True):
                many(node[s : s + n], *(w[s : s + n] for w in fp))

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "cell", *FP)])
            size += len(held[-1][0])
            if size < ROWS:
                continue
            now = [np.concatenate(x) for x in zip(*held, strict=True)]
            other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                work(*(x[:last] for x in now))
            # A bucket that goes on waits for twice as many rows before it is looked at again.
            held = [[x[last:] for x in now]]
            size = (len(now[0]) - last) // 2
        if held and sum(len(h[0]) for h in held):
            work(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from _stars(forest)

    return run


def to_least(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect the same as those of all tasks: each b of an entry, and the entry, to its least b.

    An entry is in as many buckets as there are variants, or in as many cells as its group has blocks, and
    each task may link it to another b. Of all entries of a group the least b are few, so what is left
    after this is about one link for each entry, however many tasks its group met in. There is no join,
    and an entry's links are as many as its buckets or cells at most.
    """
    least = F.min("b").over(Window.partitionBy("a"))
    return links.repartition("a").distinct().select(F.when(F.col("b") == least, F.col("a")).otherwise(F.col("b")).alias("a"), least.alias("b"))


def candidates(entries: DataFrame, n: int) -> DataFrame:
    """(a, b): links of nodes of distinct entries(a, b, c) that connect all that meet within RADIUS."""
    spark = entries.sparkSession
    most = max(20_000, n // 10_000)
    hot: dict[int, int] = {}
    if n > most:
        values = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(FP[w], lo).bitwiseAND((1 << WIDTH) - 1).alias("v")) for k, (w, lo) in enumerate(CUT)])
        for r in entries.select(F.explode(values).alias("x")).groupBy("x.k", "x.v").count().where(F.col("count") > most).collect():
            for bit in range(WIDTH):
                key = ((r.k * WIDTH + bit) << 32) | ((r.v >> (bit + 1)) << bit) | (r.v & ((1 << bit) - 1))
                hot[key] = hot.get(key, 0) + r["count"]
    rows = entries.select(*FP, F.explode(F.sequence(F.lit(0), F.lit(len(CUT) * WIDTH - 1))).alias("pos")).select(_variant(F.col("pos")).alias("key"), *FP)
    if hot:
        # Each pair of a hot bucket's blocks meets in one cell. At most 10,000 values of a segment are hot.
        sizes = spark.createDataFrame([(k, -(-c // most) + 1) for k, c in hot.items()], "key long, blocks int")
        own = F.pmod(F.xxhash64(*FP), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * 65536 + F.greatest(j, own))
        rows = rows.join(F.broadcast(sizes), "key", "left").select("key", *FP, F.explode(F.coalesce(cells, F.array(F.lit(0)))).alias("cell"))
    else:
        rows = rows.select("key", *FP, F.lit(0).alias("cell"))
    return to_least(rows.repartition(partitions(spark, n * len(CUT) * WIDTH), "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(tidied(_candidates(RADIUS)), "a long, b long"))


def _verify(words: int, least: float):
    """Rows come sorted by (label, cell): links of those at least so similar, by a search."""

    def search(rows):
        sigs, sets = np.array([r[0] for r in rows]), [shingle_set(r[1], words) for r in rows]
        fp = np.array([r[2:] for r in rows], np.int64).view(np.uint64)
        size = np.array([len(s) for s in sets])
        left, out = np.arange(len(rows)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            group = [queue[0]]
            while queue and len(left):
                one = queue.pop()
                maybe = popcount(fp[left] ^ fp[one]).sum(1, dtype=np.int16) <= RADIUS
                maybe &= np.minimum(size[left], size[one]) >= least * np.maximum(size[left], size[one]) * (1 - 1e-9)
                got = np.array([i for i in left[maybe].tolist() if similarity(sets[i], sets[one]) >= least], np.int64)
                left = left[~np.isin(left, got)]
                queue += got.tolist()
                group += got.tolist()
            least_sig = min(int(sigs[i]) for i in group)
            out += [(int(sigs[i]), least_sig) for i in group if int(sigs[i]) != least_sig]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ("a", "b"))

    def run(batches):
        now, held = None, []
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for label, cell, sig, *fp, text in zip(*(batch.column(c).to_pylist() for c in ("label", "cell", "sig", *FP)), texts, strict=True):
                if (label, cell) != now:
                    if len(held) > 1:
                        yield search(held)
                    now, held = (label, cell), []
                held.append((sig, text or b"", *fp))
        if len(held) > 1:
            yield search(held)

    return run


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, keep_id, keep_hash, group_size), one row per row of docs in a group of more than one row.

    Of a group stays one row with keep_id, its smallest doc_id, and keep_hash as its text_hash().
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    digest = materialize(rows.mapInArrow(tidied(_digest(words)), "doc_id long, text_hash long, sig long, size long, a long, b long, c long, node long"), "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    entries = materialize(digest.groupBy("sig", *FP, "node").agg(first, F.max("size").alias("size"), F.count("*").alias("n")), "entries")
    prints = entries.groupBy("node", *FP).agg(F.count("*").alias("sets"))
    total = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    labels = connected_components(candidates(prints.select(*FP), total.entries)).withColumnRenamed("component", "label")
    # Different sets with one fingerprint are candidates too.
    alike = prints.where("sets > 1").select("node").join(labels, "node", "left_anti").withColumn("label", F.col("node"))
    linked = materialize(entries.join(broadcast_within(labels.unionByName(alike)), "node").select("label", "sig", "first", "size", *FP), "linked")
    # Cells: groups of more than a block's rows or bytes are dealt out in block pairs.
    blocks = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("size") / CELL_BYTES)).cast("int")
    large = broadcast_within(linked.groupBy("label").agg(blocks.alias("blocks")).where("blocks > 1"))
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * 65536 + F.greatest(j, own))
    wanted = linked.select("label", "sig", *FP, F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    texts = rows.join(broadcast_within(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).dropDuplicates(["sig"])
    texts = texts.join(large, "label", "left").select("label", F.explode(F.coalesce(cells, F.array(F.lit(0)))).alias("cell"), "sig", *FP, "text")
    verified = texts.repartition(partitions(spark), "label", "cell").sortWithinPartitions("label", "cell").mapInArrow(tidied(_verify(words, least)), "a long, b long")
    found = connected_components(to_least(verified)).select(F.col("node").alias("sig"), "component")
    # Groups: what links connect, and sets that several rows share.
    members = entries.join(broadcast_within(found), "sig", "left").where("component IS NOT NULL OR n > 1").select("sig", "n", "first", F.coalesce("component", "sig").alias("component"))
    members = materialize(members, "members")
    kept = members.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size"))
    members = join_groups(members.select("component", "sig", "n"), kept.withColumn("size", F.col("group_size")), ["component"], "size", total.rows)
    groups = members.select("sig", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"), "group_size")
    out = join_groups(digest.select("doc_id", "text_hash", "sig"), groups, ["sig"], "n", total.rows)
    return out.where("keep_hash IS NOT NULL").select("doc_id", "text_hash", "keep_id", "keep_hash", "group_size")
