"""Exact and near dedup, components, decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sidewind.llm import common, decontam, exact_dedup, near_copies, simhash_dedup
from sidewind.llm.simhash_dedup import LOWER, WORD


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_xxh64_is_sparks(spark):
    for s in ("", "a", "x" * 31, "é" * 50 + "z"):
        assert spark.createDataFrame([(s,)], "s string").select(F.xxhash64("s")).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_directory_doubles():
    entries, buckets = exact_dedup.directory({0: 10, 1: 10, 2: 1, 3: 1}, 2, 10)
    assert entries == [0, 1, 2, 2] and [d for _, d, _ in buckets] == [2, 2, 1]
    assert exact_dedup.directory({}, 4, 10)[0] == [0]
    assert exact_dedup.directory({5: 100}, 4, 10)[1][-1][1] <= 4


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(spark, docs, collide):
    """With one key for all texts, chains and bytes alone tell them apart."""
    some = docs.where("doc_id < 60") if collide else docs
    key = F.lit(7).cast("long") if collide else None
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(some, key=key, bucket_bytes=100_000).collect()}
    import re

    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in some.collect()}
    n, first = Counter(norm.values()), {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    assert got == {i: (first[t], n[t], first[t] == i) for i, t in norm.items()}


def test_fingerprint_by_hand():
    text = b"One two  three FOUR five\tsix"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash_dedup.fingerprint(text, 4) == want
    assert simhash_dedup.fingerprint(b" \n", 4) == 0
    assert simhash_dedup.fingerprint(b"a b", 4) == xxhash.xxh64_intdigest(b"a b", 42)


def brute_components(fps, radius):
    up = {f: f for f in fps}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return root


@pytest.mark.parametrize(("radius", "hot"), [(4, 20_000), (7, 20_000), (4, 50)])
def test_links_connect_all_within_radius(spark, monkeypatch, radius, hot):
    """A ball of fingerprints around a centre, and others; with a low bound the hot path deals out blocks."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(300):
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 6)):
            f ^= 1 << b
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash_dedup, "max", lambda *a: hot if a == (20_000, len(fps) // 10_000) else max(*a), raising=False)
    df = spark.createDataFrame([(s, 0, s) for s in signed], "fp long, more long, node long")
    edges = simhash_dedup.links(df, radius, len(fps))
    assert edges.count() < 64 * len(fps)
    comp = {r.node & (2**64 - 1): r.component for r in common.connected_components(edges).collect()}
    root = brute_components(fps, radius)
    for f in fps:
        for g in list(fps)[:80]:
            same = f == g or (f in comp and g in comp and comp[f] == comp[g])
            assert same == (root(f) == root(g))


def test_near_dedup_takes_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(9, text), (4, text), (7, text.replace("w5 ", "x5 ")), (1, "something else entirely here now")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_dedup(df).collect()} == {9: 4, 4: 4, 7: 4, 1: 1}


def altered(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("cell", [4000, 7])
def test_near_copies_equal_brute_force(spark, monkeypatch, cell):
    """Families from loose to tight: every group is one that links of similarity 0.8 make, in cells of any size."""
    rng, texts = random.Random(11), []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        share = rng.choice([0.005, 0.01, 0.02, 0.03])
        texts += [" ".join(words), *(altered(rng, words, share) for _ in range(rng.randint(1, 9)))]
    monkeypatch.setattr(near_copies, "CELL_ROWS", cell)
    sets = [near_copies.shingle_set(t.encode(), 5) for t in texts]
    up, links = list(range(len(texts))), 0

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_copies.similarity(sets[i], sets[j]) >= 0.8:
                links += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in near_copies.near_copies(df).collect()}
    size = Counter(root(i) for i in range(len(texts)))
    assert links > 150 and 5 < sum(n == 1 for n in size.values()) < 100
    assert got == {i: (root(i), size[root(i)]) for i in range(len(texts)) if size[root(i)] > 1}


@pytest.mark.parametrize(("hot", "dense"), [(20_000, 16), (20_000, 0), (30, 16)])
def test_candidates_connect_all_that_meet(spark, monkeypatch, hot, dense):
    """Against all pairs: those that share a variant and lie within the radius, with buckets searched or dealt out."""
    rng, prints = random.Random(8), set()
    centre = [rng.getrandbits(64) for _ in range(3)]
    while len(prints) < 300:
        base = rng.choice([centre, centre, [rng.getrandbits(64) for _ in range(3)]])
        flip = rng.sample(range(192), rng.randint(0, 40))
        prints.add(tuple(w ^ sum(1 << (f % 64) for f in flip if f // 64 == k) for k, w in enumerate(base)))
    prints = sorted(prints)
    monkeypatch.setattr(near_copies, "max", lambda *a: hot if a == (20_000, 0) else max(*a), raising=False)
    monkeypatch.setattr(near_copies, "DENSE", dense)
    signed = [[x - (1 << 64) if x >> 63 else x for x in p] for p in prints]
    node = near_copies.node_of(*(np.array(x, np.uint64) for x in zip(*prints, strict=True))).view(np.int64).tolist()
    edges = near_copies.candidates(spark.createDataFrame(signed, "a long, b long, c long"), len(prints))
    comp = {r.node: r.component for r in common.connected_components(edges).collect()}
    mask, pairs = (1 << near_copies.WIDTH) - 1, 0
    for i, p in enumerate(prints):
        for j in range(i):
            x = [u ^ v for u, v in zip(p, prints[j], strict=True)]
            meets = any((x[w] >> lo & mask).bit_count() <= 1 for w, lo in near_copies.CUT)
            if meets and sum(u.bit_count() for u in x) <= near_copies.RADIUS:
                pairs += 1
                assert comp[node[i]] == comp[node[j]]
    assert pairs > 500


def test_links_of_a_large_group_are_few(spark):
    """A group that meets in all tasks, each time as another part of it, gives about one link for each entry and stays whole."""
    rng, centre = random.Random(5), [0x123456789ABCDEF0, 0x0FEDCBA987654321, 0x5555AAAA3333CCCC]
    prints = {tuple(w ^ sum(1 << (f % 64) for f in flip if f // 64 == k) for k, w in enumerate(centre)) for flip in (rng.sample(range(192), rng.randint(18, 26)) for _ in range(800))}
    signed = [[x - (1 << 64) if x >> 63 else x for x in p] for p in prints]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        links = {(max(r), min(r)) for r in near_copies.candidates(spark.createDataFrame(signed, "a long, b long, c long"), len(prints)).collect() if r.a != r.b}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for link in links for x in link}
    assert len(nodes) > 700 and len({root(x) for x in nodes}) == 1
    assert len(links) < 2 * len(nodes)


def test_links_to_least_connect_the_same(spark):
    rng = random.Random(4)
    links = [(max(x), min(x)) for x in (rng.sample(range(300), 2) for _ in range(260))] * 2 + [(9000 + i, i % 3) for i in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    got = near_copies.to_least(df).collect()
    assert all(r.a > r.b for r in got) and len(got) <= len(set(links))
    want = {r.node: r.component for r in common.connected_components(df).collect()}
    assert want == {r.node: r.component for r in common.connected_components(near_copies.to_least(df)).collect()}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(60))


def test_hot_groups_join_whole(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(6000)], "i long, k string")
    groups = spark.createDataFrame([("hot", 2000, 1), ("k1", 1, 2)], "k string, n long, v int")
    out = common.join_groups(rows, groups, ["k"], "n", 6000)
    assert out.count() == 6000 and out.where("v = 1").count() == 2000 and out.where("v = 2").count() == 1


def brute_matches(items, text):
    w = WORD.findall(text.encode().translate(LOWER))
    out = {}
    for i, t in items:
        v = WORD.findall(t.encode().translate(LOWER))
        if not v:
            continue
        k = min(5, len(v))
        want = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
        have = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        m = min(len(v), len(w)) - k + 1
        for s in range(len(have) - m + 1 if m > 0 else 0):
            c = Counter(have[s : s + m])
            both = sum((c & want).values())
            sim = both / (c.total() + want.total() - both)
            if sim >= 0.8 and sim > out.get(i, (0, 0))[1]:
                out[i] = (s, sim)
    return out


def test_decontamination_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.Index(items)
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for _ in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zzz"
        base = rng.choice(texts).split()[:80]
        at = rng.randint(0, len(base))
        texts.append(" ".join(base[:at] + w + base[at:]))
    found = 0
    for t in texts:
        want = brute_matches(items, t)
        found += len(want)
        assert {m[0]: (m[1], m[4]) for m in index.matches(t)} == want
    assert found > 40


def test_blocks_miss_nothing_within_radius():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    index = decontam.Sized(list(range(30)), items.tolist())
    fps = np.array([int(items[k % 30]) ^ int(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(0, 40) for _ in range(20)], np.uint64)
    far = np.bitwise_count(fps[:, None] ^ items[None, :])
    for radius in (decontam.RADIUS, 7, 0):
        want = list(zip(*np.nonzero(far <= radius), strict=True))
        assert list(zip(*index.within(fps, radius), strict=True)) == want and len(want) >= 20


def test_benchmark_in_blocks_and_ties(spark, monkeypatch):
    """Several blocks of items give the same matches; of equally similar windows the first counts, and equal items each match."""
    item = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, item), (2, item), (3, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y {item} z"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    want = [(1, 1, 1, 1.0), (1, 2, 1, 1.0), (2, 3, 0, 1.0)]
    for words in (decontam.BLOCK_WORDS, 1):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        got = sorted((r.doc_id, r.item_id, r.first_word, r.similarity) for r in decontam.contaminated(docs, bench).collect())
        assert got == want
        assert [r.doc_id for r in decontam.keep_clean(docs, bench).collect()] == [3]


def test_shared_folders_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda spark: tmp_path.as_uri())
    assert common.materialize(spark.range(3).toDF("i")).count() == 3
    assert common.clear_shared(spark) == 1 and common.clear_shared(spark) == 0
