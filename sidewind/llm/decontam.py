"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a document that has as many words as a benchmark item gets a 64-bit SimHash of its
five-word shingles, weighted by how often they occur. A multi-index of Hamming blocks leads from a
window to the items of its size within ``radius`` bits: the fingerprint is cut into blocks, and of two
fingerprints within the radius at least one block differs by at most radius // blocks bits, so looking
up each block's value and all values so near finds every item. Candidates are then verified by the
exact similarity of their weighted shingles (sum of the smaller counts over sum of the larger), which
must reach ``least``.

Windows are skipped only where verification could not succeed: a window whose shingles that occur in
any item are fewer than ``least`` of the larger size reaches no similarity of ``least`` with any item.

Size: documents are scanned once, in place, without a shuffle. The items' index is broadcast in
blocks of at most BLOCK_WORDS words; of a larger benchmark each block's matches are written before the
next block is made. Long documents are windowed in slices, so memory does not grow with their length.

Defined results: null or empty texts and items match nothing; items of fewer than five words count
as one shingle; a document shorter than an item is one window; equal items each match; of equally
similar windows the first is given; repeated rows each give their rows; empty tables give an empty
result. Only the id and text columns are read, but for keep_clean, which passes all columns on.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, tidied
from .simhash_dedup import bits_of, majority, popcount, shingle_hashes

SHINGLE, LEAST, RADIUS, BLOCKS = 5, 0.8, 23, 8
WIDTH = 64 // BLOCKS
#: All values of a block, by their number of bits.
NEAR = np.array(sorted(range(1 << WIDTH), key=lambda v: (v.bit_count(), v)))
#: Words of benchmark items that are broadcast at once; windows that are fingerprinted at once.
BLOCK_WORDS, SLICE = 2_000_000, 8192


class Sized:
    """The items of one number of shingles: their fingerprints by block value."""

    def __init__(self, items: list[int], prints: list[int]):
        self.items, self.prints = np.array(items), np.array(prints, np.uint64)
        values = self.blocks(self.prints)
        order = [np.argsort(v, kind="stable") for v in values.T]
        #: Places by block and value, and where each value of each block begins.
        self.order = np.concatenate(order)
        starts = [np.searchsorted(v[o], np.arange((1 << WIDTH) + 1)) + j * len(prints) for j, (v, o) in enumerate(zip(values.T, order, strict=True))]
        self.first = np.concatenate(starts)

    @staticmethod
    def blocks(fps: np.ndarray) -> np.ndarray:
        """One row of block values for each fingerprint."""
        return np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), BLOCKS).astype(np.int64)

    def within(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in items) of all fingerprints within the radius, by any block's near values."""
        near = NEAR[: np.searchsorted(popcount(NEAR), radius // BLOCKS, "right")]
        value = (self.blocks(fps)[:, :, None] ^ near) + np.arange(BLOCKS)[:, None] * ((1 << WIDTH) + 1)
        low, high = self.first[value].ravel(), self.first[value + 1].ravel()
        full = np.flatnonzero(high > low)
        low, n = low[full], (high - low)[full]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair = np.unique(np.repeat(full // (BLOCKS * len(near)), n) * len(self.prints) + self.order[at])
        w, i = np.divmod(pair, len(self.prints))
        ok = popcount(fps[w] ^ self.prints[i]) <= radius
        return w[ok], i[ok]


class Index:
    """Items by their number of shingles, and which shingles occur in any of them."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, least: float = LEAST):
        self.radius, self.least, self.items = radius, least, []
        shingles, sized = defaultdict(set), defaultdict(list)
        for item_id, text in items:
            raw = (text or "").encode("utf-8", "surrogatepass")
            n_words = len(raw.split())
            k = min(SHINGLE, n_words)
            if not k:
                continue
            hashes = shingle_hashes(raw, k)
            shingles[k].update(hashes.tolist())
            sized[k, len(hashes)].append(len(self.items))
            self.items.append((item_id, n_words, Counter(hashes.tolist()), int(majority(bits_of(hashes).sum(0, dtype=np.int64), len(hashes)))))
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in sorted(shingles.items())}
        self.sized = {km: Sized(at, [self.items[i][3] for i in at]) for km, at in sorted(sized.items())}

    def similarity(self, window: np.ndarray, item: Counter) -> float:
        counts = Counter(window.tolist())
        both = sum(min(n, item[h]) for h, n in counts.items() if h in item)
        return both / (len(window) + item.total() - both)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, bits that differ, similarity): each item's best window."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        best: dict[int, tuple] = {}
        for k, known in self.known.items():
            hashes = shingle_hashes(raw, k)
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            hits = known[at] == hashes
            if not hits.any():
                continue
            n_words = len(raw.split()) if len(hashes) == 1 else None
            seen = np.concatenate([[0], np.cumsum(hits)])
            for (_, m), sized in ((km, v) for km, v in self.sized.items() if km[0] == k):
                size = min(m, len(hashes))
                starts = np.flatnonzero(seen[size:] - seen[:-size] >= self.least * max(size, m) - 1e-9)
                for part in np.split(starts, np.flatnonzero((np.diff(starts) > size) | (np.arange(1, len(starts)) % SLICE == 0)) + 1) if len(starts) else ():
                    sums = np.zeros((part[-1] - part[0] + size + 1, 64), np.int32)
                    np.cumsum(bits_of(hashes[part[0] : part[-1] + size]), axis=0, out=sums[1:])
                    fps = majority(sums[part - part[0] + size] - sums[part - part[0]], size)
                    for w, i in zip(*(x.tolist() for x in sized.within(fps, self.radius)), strict=True):
                        s, item = int(part[w]), int(sized.items[i])
                        item_id, words, counts, fp = self.items[item]
                        sim = self.similarity(hashes[s : s + size], counts)
                        if sim >= self.least and (item not in best or sim > best[item][-1]):
                            best[item] = (item_id, s, min(words, n_words or words), int(popcount(fps[w] ^ np.uint64(fp))), sim)
        return [best[i] for i in sorted(best)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of items, each of at most BLOCK_WORDS words (or a single item)."""
    block, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len((r.t or "").split())
        if block and held + n > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, bits, similarity): for each document and each item it holds, the most similar window."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ("doc_id", "item_id", "first_word", "n_words", "bits", "similarity")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())

    def scan(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                out = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in index.matches(t)]
                cols = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        return run

    found, blocks = None, _blocks(benchmark, item_id, item_text)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(Index(block, radius, least))
        part = rows.mapInArrow(scan(shared), "doc_id long, item_id long, first_word long, n_words long, bits int, similarity double")
        if after is not None or found is not None:
            part = materialize(part, "matches")
            shared.destroy()
        found, block = part if found is None else found.unionByName(part), after
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text_col)

    def scan(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for block in _blocks(benchmark, item_id, item_text):
        docs = docs.mapInArrow(tidied(scan(spark.sparkContext.broadcast(Index(block, radius, least)))), docs.schema)
    return docs
