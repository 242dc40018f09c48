"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, those with the smallest hash of id) each vector is joined to its
nearest others. This graph is cut into parts of equal size with few edges between them: halving along
directions of largest spread starts, then vectors move to the part of most of their neighbours as far as
there is room. A small network learns from the sample into which parts a vector's neighbours fall. It
deals every row of the table to its most probable part, and each query to several parts, most probable
first; those rows are ranked by the exact measure. How many parts a query visits is set on vectors of the
sample that the graph and the network have not seen: the least number with which ``RECALL`` of their
nearest in the sample are in the parts visited.

Size: rows are kept in blocks of about ``BLOCK`` vectors of a part, and so are a part's queries; blocks
meet by equality joins of (part, group of row blocks), so a part of any size is spread over tasks. Of
equal vectors only the k + 1 with the smallest ids can be among anyone's nearest, so others are dealt to
no block: they are not searched but search themselves, which loses nothing. The number of parts grows
with the square root of the table, up to one for 32 vectors of the sample.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id or, where lengths differ, those of another than the most frequent length; a
query's own row is any with its id; of query rows that share an id the one with the least vector asks;
repeated rows are candidates each; ties go to the smaller id; an empty table gives an empty result; only
the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship

#: Vectors that are fitted on; neighbours in the graph; rows of a block; row blocks of a group that queries are sent to.
SAMPLE, EDGES, BLOCK, GROUP = 8192, 12, 4096, 8
#: Share of held-out neighbours that the visited parts must hold; rounds of cutting; passes and width of the network.
RECALL, ROUNDS, EPOCHS, HIDDEN = 0.95, 20, 30, 64
#: Found rows that a task holds before it drops those beyond each query's k.
HELD = 2_000_000


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    v = F.col("vec")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vec") == F.lit(sizes[0].d if sizes else 0))


def without_copies(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the ``most`` smallest ids of each vector."""
    w = Window.partitionBy(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec")).orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def nearest_in(sample: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of each query's k nearest in the sample, itself (its place in own) left out."""
    out = []
    for i in range(0, len(queries), 1024):
        s = queries[i : i + 1024] @ sample.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + 1024]] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def halved(vectors: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of equal size (to one row) by halving along the direction of largest spread, again and again."""
    part = np.zeros(len(vectors), np.int64)
    todo = [(np.arange(len(vectors)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        x = vectors[rows] - vectors[rows].mean(0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):
            axis = x.T @ (x @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = rows[np.argsort(x @ axis, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    return part


def cut_graph(edges: np.ndarray, part: np.ndarray, parts: int, slack: float = 0.05, rounds: int = ROUNDS) -> np.ndarray:
    """Moves vertices to the part of most of their neighbours, the largest gains first, while parts stay within (1 + slack) of their share.

    edges(vertex, neighbours); an edge counts for both its ends.
    """
    n = len(part)
    part, room = part.copy(), int(np.ceil(n / parts * (1 + slack)))
    a, b = np.repeat(np.arange(n), edges.shape[1]), edges.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        near = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        best = near.argmax(1)
        gain = near[np.arange(n), best] - near[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable")[: np.count_nonzero(gain > 0)].tolist():
            if size[best[v]] < room and size[part[v]] > 1:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer that gives each part's probability of holding a vector's neighbours."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """The most probable parts of each row, most probable first."""
        s = self.logits(x)
        return np.argsort(-s, axis=1, kind="stable")[:, :most]


def learn(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> Router:
    """Fits the network to shares of parts by cross entropy (Adam, steps of 128 rows)."""
    d, parts = x.shape[1], target.shape[1]
    x, target = x.astype(np.float32), target.astype(np.float32)
    scale = np.float32(1 / (np.sqrt((x**2).mean()) or 1.0))
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)) * scale, np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w = [p.astype(np.float32) for p in w]
    rates = [3e-3 * scale, 3e-3, 3e-3, 3e-3]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            rows = order[i : i + 128]
            xb, yb = x[rows], target[rows]
            h = np.maximum(xb @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - yb) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            t += 1
            for j, grad in enumerate((xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad**2
                step = rates[j] * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
                w[j] = w[j] - step.astype(np.float32)
    return Router(*w)


def fit(sample: np.ndarray, rows: int, k: int, recall: float = RECALL) -> Router:
    """Parts, network and number of visits from a sample of a table of so many rows."""
    rng = np.random.default_rng(0)
    held = max(len(sample) // 10, 1) if len(sample) >= 64 else 0
    test, train = sample[:held], sample[held:]
    parts = max(1, min(round(np.sqrt(rows) / 2), len(train) // 32))
    x = train.astype(np.float32)
    if parts == 1:
        d = sample.shape[1]
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    near = nearest_in(x, x, EDGES, np.arange(len(x)))
    part = cut_graph(near, halved(x, parts, rng), parts)
    shares = np.zeros((len(x), parts))
    np.add.at(shares, (np.arange(len(x))[:, None], part[near]), 1 / (EDGES + 2))
    shares[np.arange(len(x)), part] += 2 / (EDGES + 2)
    router = learn(x, shares, rng)
    dealt = router.order(x, 1)[:, 0]
    want = dealt[nearest_in(x, test.astype(np.float32), min(k, len(x)))]
    place = np.empty((len(test), parts), np.int64)
    np.put_along_axis(place, router.order(test, parts), np.broadcast_to(np.arange(parts), place.shape), 1)
    at = np.sort(np.take_along_axis(place, want, 1).ravel())
    router.visits = int(at[min(int(np.ceil(recall * len(at))), len(at)) - 1]) + 1
    return router


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _route(router: Router, visits: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = router.order(_vectors(batch.column("vec")), visits)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), parts.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(parts.ravel().astype(np.int32)), batch.column("vec_id").take(rows), batch.column("vec").take(rows)], ("part", "vec_id", "vec"))

    return run


def routed(rows: DataFrame, router: Router, visits: int) -> DataFrame:
    """(part, vec_id, vec): each row in its most probable parts."""
    return rows.mapInArrow(_route(router, visits), "part int, vec_id long, vec array<double>")


def blocks(rows: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """(part, block, ids, vectors): the rows of each part in blocks of about BLOCK, dealt by hash of id and vector."""
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    dealt = rows.join(F.broadcast(sizes), "part").withColumn("_b", F.pmod(F.xxhash64("vec_id", "vec"), F.col("_n")).cast("int"))
    return dealt.groupBy("part", F.col("_b").alias(names[0])).agg(F.collect_list(F.struct("vec_id", "vec")).alias(names[1]), F.max("_n").alias(names[2]))


def _best(found: list[tuple], k: int) -> list[np.ndarray]:
    """Of (query, id, score) rows those with each query's k highest scores, smaller ids first where equal."""
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return [c[rank < k] for c in (q, i, s)]


def _rank(k: int):
    def of(column, n):
        flat = column[n].values
        return flat.field("vec_id").to_numpy(), np.ascontiguousarray(_vectors(flat.field("vec")))

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ("query_id", "vec_id", "score"))

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for n in range(batch.num_rows):
                (qi, q), (ri, r) = of(batch.column("queries"), n), of(batch.column("rows"), n)
                for at in range(0, len(qi), 512):
                    s = q[at : at + 512] @ r.T
                    s[qi[at : at + 512, None] == ri[None]] = -np.inf
                    if s.shape[1] > k:
                        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        # The product's rounding depends on a row's place; what is near the k-th is measured again below.
                        x, y = np.nonzero((s >= kth - 1e-12 * (np.abs(kth) + 1)) & (s > -np.inf))
                    else:
                        x, y = np.nonzero(s > -np.inf)
                    found.append((qi[at + x], ri[y], (q[at + x] * r[y]).sum(1)))
                    size += len(x)
                if size > HELD:
                    found = [tuple(_best(found, k))]
                    size = len(found[0][0])
                    if size > HELD // 2:
                        yield told(found[0])
                        found, size = [], 0
        if found:
            yield told(_best(found, k))

    return run


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that is a query.

    is_query is over the column ``vec_id``.
    """
    spark = table.sparkSession
    ship(spark)
    rows = materialize(usable(table, id_col, vec_col), "vectors")
    indexed = materialize(without_copies(rows, k + 1), "indexed")
    n = indexed.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    share = indexed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(min(1 << 40, (1 << 40) * 3 * sample // (2 * n) + 1)))
    picked = share.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    router = fit(_vectors(picked.column("vec").combine_chunks()), n, k, recall)

    r = blocks(materialize(routed(indexed, router, 1), "dealt"), ("rb", "rows", "n")).withColumn("g", F.floor(F.col("rb") / GROUP).cast("int"))
    groups = r.groupBy("part").agg(F.max("g").alias("_g"))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    q = blocks(materialize(routed(asked, router, router.visits), "asked"), ("qb", "queries", "_m")).drop("_m")
    q = q.join(F.broadcast(groups), "part").withColumn("g", F.explode(F.sequence(F.lit(0), "_g"))).drop("_g")
    found = r.select("part", "g", "rows").join(q.select("part", "g", "queries"), ["part", "g"]).select("rows", "queries").mapInArrow(_rank(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
