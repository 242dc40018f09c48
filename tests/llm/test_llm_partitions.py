"""Learned partitions against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidewind.llm import learned_partitions as lp
from sidewind.llm import queries


def brute(rows, is_query, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if is_query(i)}):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s.round(12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(len(want[q]), 1) for q in want])


def test_query_reaches_recall_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answers(queries.op13_learned_partitions(spark, sf)), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.92
    x = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - x[q] @ x[i]) < 1e-12 for i, s in found)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    weight = np.r_[0.35, np.full(39, 0.65 / 39)]
    x = centres[rng.choice(40, 4000, p=weight)] + 0.25 * rng.normal(size=(4000, 16))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_few_parts_are_visited_where_there_is_structure(spark, clustered, monkeypatch):
    seen = []
    fit = lp.fit
    monkeypatch.setattr(lp, "fit", lambda *a: seen.append(fit(*a)) or seen[-1])
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    got, want = answers(lp.search(df, F.col("vec_id") % 50 == 0, 10, sample=2000)), brute(clustered, lambda i: i % 50 == 0, 10)
    assert recall(got, want) >= 0.92 and seen[0].parts >= 30 and seen[0].visits <= seen[0].parts / 3


def test_cut_keeps_balance_and_lowers_edges(clustered):
    x = np.array([v for _, v in clustered], np.float32)[:2000]
    near = lp.nearest_in(x, x, 12, np.arange(2000))
    first = lp.halved(x, 20, np.random.default_rng(0))
    part = lp.cut_graph(near, first, 20)
    cut = lambda p: (p[near] != p[:, None]).mean()
    assert np.bincount(first, minlength=20).tolist() == [100] * 20
    assert np.bincount(part, minlength=20).max() <= 105 and cut(part) < 0.9 * cut(first)
    assert not any(i in row for i, row in enumerate(near.tolist()))


def test_copies_ties_and_unusable_rows(spark):
    """A third of the rows are one vector; ties go to the smaller ids; what takes no part is no candidate."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 900)]
    odd = [(1000, None), (1020, []), (1040, [0.0, 0.0, 0.0]), (1060, [1.0, None, 2.0]), (1080, [float("nan"), 1.0, 1.0]), (1100, [float("inf"), 1.0, 1.0]), (1120, [9.0, 9.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in ("vec", "part", "rows", "n", "g", "score")])
    got, want = answers(lp.search(df, F.col("vec_id") % 20 == 0, 5, recall=1.0)), brute(rows, lambda i: i % 20 == 0, 5)
    assert got.keys() == want.keys()
    for q in [q for q in want if q < 300]:
        assert [i for i, _ in got[q]][:5] == [i for i, _ in want[q]][:5] or got[q][0][1] > 1.0
    assert recall(got, want) >= 0.95


def test_repeated_rows_and_small_tables(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(lp.search(df, F.col("vec_id") % 20 == 0, 3))
    assert got == {0: [(1, 5.0), (1, 5.0), (20, 1.5)], 20: [(1, 2.0), (1, 2.0), (0, 1.5)]}
    assert answers(lp.search(df.limit(1), F.lit(True), 3)) == {}
    assert lp.search(df.where("false"), F.lit(True), 3).count() == 0
