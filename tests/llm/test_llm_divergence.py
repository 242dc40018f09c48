"""Source divergence against the definition."""

import random

import pytest
from pyspark.sql import functions as F

from sidewind.llm import divergence as dv


def brute(rows, least, top):
    docs = [((lang or ""), (source or ""), [t.decode() for t in dv.TERM.findall((text or "").encode().translate(dv.LOWER))]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        every = {t for d in mine for t in d[2]}
        kept = sorted(t for t in every if sum(t in d[2] for d in mine) >= least)
        sources = sorted({d[1] for d in mine})
        count = {s: {t: sum(d[2].count(t) for d in mine if d[1] == s) for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[None][t] - p[s][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "X", "日")]

    def some(source):
        return " 1 ".join(rng.choices(words, weights=[1 + (sum(map(ord, w)) + len(source or "")) % 7 for w in words], k=rng.randrange(30)))

    return [(some(s), rng.choice(["en", "de", None]), s) for s in rng.choices(["s1", "s2", "s3é", "s4", None], weights=[9, 2, 2, 1, 1], k=n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_definition(spark, seed):
    rows = [*rows_of(seed), (None, "en", "s5"), ("", "xx", "s1"), ("a a", "xx", "s2"), ("word " * 60_000, "en", "s1"), *[("b c", "yy", None)] * 5]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    for least, top in ((3, 4), (1, 50), (10**6, 5)):
        got = {tuple(r) for r in dv.divergence(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert got == brute(rows, least, top)


def test_long_lists_go_in_tiles(monkeypatch):
    """Sums are handed on in parts where they outgrow the task's share, and lists are cut in tiles."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(dv, "CELLS", 1000)
    monkeypatch.setattr(dv, "TILE", 7)
    rng = np.random.default_rng(3)
    lists = [[{"source": f"s{i}", "p": int(rng.integers(1, 99)), "zero": i % 5} for i in rng.permutation(60)[:40]] for _ in range(5)]
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "list": x} for x in lists])
    got = {}
    for out in dv._correct([batch]):
        for r in out.to_pylist():
            old = got.get((r["a"], r["b"]), (0, 0))
            got[r["a"], r["b"]] = (old[0] + r["fix"], old[1] + r["common"])
    want = {}
    for x in lists:
        for a in x:
            for b in x:
                fix = abs(a["p"] - b["p"]) - abs(a["p"] - b["zero"]) - abs(a["zero"] - b["p"]) + abs(a["zero"] - b["zero"])
                old = want.get((a["source"], b["source"]), (0, 0))
                want[a["source"], b["source"]] = (old[0] + fix, old[1] + 1)
    assert got == want


def test_prices_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(dv.price(F.lit(10**15), F.lit(3 * 10**15), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([("a b", "en", "s1"), ("a", "en", "s2")], "text string, lang string, source string")
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("term", "n", "docs", "list", "p", "zero", "kept", "item")])
    assert sorted(map(tuple, dv.divergence(extra, 1).collect())) == sorted(map(tuple, dv.divergence(df, 1).collect()))
    assert dv.divergence(df.where("false")).count() == 0
