"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sidewind.llm import bpe, ctw, decontam, exact_dedup, licenses, secrets, simhash_dedup, token_store, toxicity, url_filter

LONG = "word " * 60_000 + "end"
ROWS = [(1, "a b"), (1, "a b"), (None, "a  b"), (2, None), (3, ""), (4, LONG), (5, "Ünïcode \u0000 text <|endoftext|>"), (6, "  ")]
EXTRA = ["row", "w", "_k", "key", "part", "h", "sha", "fp", "kind", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "hi")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, toxic int")


WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def run(name, spark, docs, bench, labels):
    return {
        "exact": lambda: exact_dedup.exact_dedup(docs),
        "near": lambda: simhash_dedup.near_dedup(docs),
        "near2": lambda: simhash_dedup.near_dedup(docs, words=5, radius=9, more_radius=18),
        "lm": lambda: ctw.lm_score(docs, depth=3),
        "license": lambda: licenses.license_scan(docs),
        "secret": lambda: secrets.secret_scan(docs, F.col("h"), F.col("sha")),
        "toxic": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
        "bpe": lambda: bpe.bpe_digests(docs, WORD),
        "tokens": lambda: token_store.digests(token_store.read_tokens(spark, token_store.write_tokens(docs, BYTE, 2))),
    }[name]()


NAMES = ["exact", "near", "near2", "lm", "license", "secret", "toxic", "bpe", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, docs, bench, labels, name):
    got = run(name, spark, docs, bench, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, bench, labels, name):
    assert run(name, spark, docs.where("false"), bench, labels).count() == 0


def test_decontamination_edges(spark, docs, bench):
    plant = spark.createDataFrame([(7, "x y One two three four five six z"), (8, "say hi to them"), (9, "one two three")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(plant)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(both, bench).collect()}
    assert got == {(7, 1), (8, 4)}
    assert decontam.contaminated(both, bench.where("false")).count() == 0
    assert decontam.contaminated(both.where("false"), bench).count() == 0
    kept = decontam.keep_clean(docs.withColumn("item_id", F.lit(1)), bench)
    assert kept.count() == len(ROWS) and "item_id" in kept.columns


def test_url_edges(spark):
    rows = [(1, None, None), (2, "nohost", ""), (3, "", "x"), (4, "HTTP://A.Example.COM/en/7?q", "<p>"), (4, "HTTP://A.Example.COM/en/7?q", "<p>"), (None, "x://y", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("own", F.lit(2))
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df).collect())
    assert got == [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("4", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("4", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("None", "y", "", None, "allow")]
    assert url_filter.url_filter(df.where("false")).count() == 0


def test_decisions_spread_over_redirects(spark):
    """Chains, targets that are no pages, relative and protocol-relative addresses, and allow before block."""
    link, go = '<LINK href="{}" rel="canonical">', "<meta http-equiv='refresh' content='3; url={}'>"
    rows = [
        (1, "http://a.test/1", link.format("http://b.test/2")),
        (2, "https://b.test/2/", go.format("/3")),
        (3, "http://b.test/3?utm_source=x", link.format("http://unseen.com/en/9")),
        (4, "http://c.test/1", link.format("//www.example.com/en/7/x")),
        (5, "http://c.test/2", link.format("1")),
        (6, "http://c.test/3", link.format("http://c.test/2") + go.format("http://d.org/es/1")),
        (7, "http://d.org/es/1", None),
        (8, "http://e.test/1", link.format("http://e.test/1")),
        (9, "http://f.test/1", link.format("")),
        (10, "http://g.com/en/1", link.format("http://www.example.com/en/7/x")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(df).collect()}
    assert {i: v for i, (_, v) in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "block"}
    assert got[7][0] == "org/es/" and got[10][0] == "com/en/" and got[1][0] is None


def test_link_addresses_are_resolved(spark):
    """Entities, dot segments, and addresses that are only a query; what leads above the root stays at it."""
    cases = [
        ("../z?p=1&amp;q=2", "http://b.test/x/z?p=1&q=2"), ("./k/./l/../m", "http://b.test/x/y/k/m"), ("../../../../up", "http://b.test/up"), ("?p=2", "http://b.test/x/y/page?p=2"), ("#top", "http://b.test/x/y/page#top"),
        ("/a/../c", "http://b.test/c"), ("//d.test/./e", "http://d.test/e"), ("HTTPS://d.test/f?u=http://g", "HTTPS://d.test/f?u=http://g"), ("h?u=http://g.test/../i", "http://b.test/x/y/h?u=http://g.test/../i"), ("q&#38;r&#x26;s", "http://b.test/x/y/q&r&s"), ("..", "http://b.test/x"),
    ]
    df = spark.createDataFrame([(i, "http://b.test/x/y/page?old=1", f'<link rel="canonical" href="{x}">') for i, (x, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.to for r in df.select("page_id", url_filter.targets(F.col("url"), F.col("html")).alias("to")).collect()}
    assert got == {i: [want] for i, (_, want) in enumerate(cases)}
    pages = [(1, "http://b.test/x/y/page", '<link rel="canonical" href="../../en/7?a=1&amp;b=2">'), (2, "http://b.test/en/7?a=1&b=2", '<link rel="canonical" href="http://z.net/de/1">')]
    out = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "block"}


def test_verdicts_of_the_rules(spark):
    """Each rule's verdict, that of the longer rule within it, and an alias by an allowed address."""
    rows = [
        (1, "http://a.com/en/1", None, "com/en/", "block"), (2, "http://a.example.com/en/7", None, "example.com/en/7", "allow"), (3, "http://a.net/de/8", None, "net/de/", "allow"),
        (4, "http://example.net/de/7", None, "net/de/", "allow"), (5, "http://www.example.net/de/81", None, "example.net/de/8", "block"), (6, "http://a.org/es/", None, "org/es/", "block"), (7, "http://net/de/", None, "net/de/", "allow"),
        (8, "http://b.test/1", '<link rel="canonical" href="http://a.net/de/9"><meta http-equiv="refresh" content="0; url=http://c.test/2">', None, "allow"), (9, "http://c.test/2", '<link rel="canonical" href="http://d.org/es/1">', None, "allow"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(df).collect()} == {i: (rule, verdict) for i, _, _, rule, verdict in rows}
