"""Ranked search against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidewind.llm import lexical as lx


def brute(docs, items, k):
    rows = [(i, Counter(lx.terms_of(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        terms = Counter(lx.terms_of(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scored = []
        for i, c in rows:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(terms[t] * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in w if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def texts(seed, n, longest=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x9"]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_finds_what_scoring_finds(seed, monkeypatch):
    """Every k and lower bound, with a narrow and a wide queue."""
    rng = np.random.default_rng(seed)
    shard = lx.Shard()
    docs = list(enumerate(texts(seed, 300)))
    for i, t in docs:
        shard.add(i, t.encode())
    row = shard.laid_out(300, 5000)
    tree = lx.Tree(row)
    place = {t: i for i, t in enumerate(row["terms"].split(b" "))}
    counts = {i: Counter(lx.terms_of(t)) for i, t in docs}
    score = lambda i, q: sum(w * (10**9 * counts[i][t] // (1000 * counts[i][t] + 8 * lx.length_norm(sum(counts[i].values()), 300, 5000))) for t, w in q if counts[i][t])
    for _ in range(20):
        monkeypatch.setattr(lx, "WIDTH", int(rng.integers(1, 80)))
        q = [(t, int(rng.integers(1, 5))) for t in rng.permutation(list(place))[: rng.integers(1, 20)].tolist()]
        k, least = int(rng.integers(1, 15)), int(rng.choice([1, 500_000, 10**7]))
        got = tree.top(*np.array([(place[t], w) for t, w in q], np.int64).T, k, least)
        want = sorted((-s, i) for i in counts if (s := score(i, q)) >= least)[:k]
        assert [(-s, tree.docs[d]) for s, d in got] == want


def test_tree_opens_few_nodes():
    """One document that holds a rare term is found without opening most of the tree."""
    shard = lx.Shard()
    for i, t in enumerate(texts(5, 4000)):
        shard.add(i, (t + (" needle needle" if i == 1234 else "") + " w0").encode())
    row = shard.laid_out(4000, 80_000)
    tree = lx.Tree(row)
    place = {t: i for i, t in enumerate(row["terms"].split(b" "))}
    seen = []
    tree.zeros = type("Z", (), {"__getitem__": lambda self, at, z=tree.zeros: (seen.append(len(at)), z[at])[1]})()
    assert tree.docs[tree.top(np.array([place[b"needle"], place[b"w0"]]), np.array([9000, 1]), 1)[0][1]] == 1234
    assert sum(seen) < 400


def test_search_over_many_shards(spark):
    docs = list(enumerate(texts(7, 400)))
    docs += [(None, "w1 w2 only"), (5, "w1 w2 only"), (5, "w1 w2 only"), (900, None), (901, ""), (902, "... !"), (903, "w3 " * 60_000)]
    items = [(1, "w1 W2 w2 unknown"), (1, "w1 W2 w2 unknown"), (None, "w40 w41"), (3, None), (4, ""), (5, "unknown"), (6, "w3"), *[(10 + i, t) for i, t in enumerate(texts(8, 20))]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    i = spark.createDataFrame(items, "item_id long, text string")
    extra = d.select("*", *[F.lit("x").alias(c) for c in ("docs", "terms", "n", "q", "score", "rank")])
    got = lx.search(lx.build_index(extra), i.withColumn("doc_id", F.lit(1)), 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 4)


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = list(enumerate(texts(9, 60))), list(enumerate(texts(10, 30, 10)))
    monkeypatch.setattr(lx, "BLOCK_TERMS", 25)
    got = lx.search(lx.build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lx.search(lx.build_index(docs.where("false")), items).count() == 0
    assert lx.search(lx.build_index(docs), items.where("false")).count() == 0
    assert lx.search(lx.build_index(docs), items).count() == 1
