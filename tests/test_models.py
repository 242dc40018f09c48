"""The engine's own models against definitions: splits, gradients, weights, adaptive search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidewind.operators import boosting, donors, models, perceptron, ratings, search


@pytest.fixture(scope="module")
def table(spark):
    """A target that depends on products of signs where a is large, and a little on d."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    z = np.where(x[:, 0] > 0.5, 2.5 * np.sign(x[:, 1] + 0.3) * np.sign(x[:, 2] + 0.3), 0.3 * x[:, 3])
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * z))).astype(int)
    rows = [(*map(float, r), int(t), float(1 + (i % 3)), i % 4 == 0) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, target int, w double, held boolean").repartition(3).cache()


NAMES = ["a", "b", "c", "d"]


def test_first_tree_equals_search_of_all_splits(table):
    edges = [[-1.0, 0.0, 1.0], [-0.5, 0.5], [-2.0, -0.3, 0.4], [0.1]]
    m = boosting.fit(table, NAMES, weight="w", rounds=1, leaves=4, depth=2, l2=2.0, least_h=3.0, edges=edges, rate=0.5)
    rows = table.collect()
    y, w = np.array([r.target for r in rows], float), np.array([r.w for r in rows])
    p = (y * w).sum() / w.sum()
    bins = np.stack([np.searchsorted(e, [r[n] for r in rows], "left") + 1 for n, e in zip(NAMES, edges, strict=True)], 1)
    g, h = w * (p - y), w * p * (1 - p)

    def best(at):
        part = lambda s: g[s].sum() ** 2 / (h[s].sum() + 2.0)
        found = []
        for f in range(4):
            for b in range(1, len(edges[f]) + 1):
                left = at & (bins[:, f] <= b)
                right = at & ~left
                if h[left].sum() >= 3 and h[right].sum() >= 3:
                    found.append((-round(part(left) + part(right) - part(at), 9), f, b))
        return min(found)

    _, f, b = best(np.ones(len(rows), bool))
    left = bins[:, f] <= b
    want = {1: (f, b), 2: best(left)[1:], 3: best(~left)[1:]}
    tree = m.trees[0]
    assert tree.splits == want and sorted(tree.leaves) == [4, 5, 6, 7]
    at = left & (bins[:, want[2][0]] <= want[2][1])
    assert abs(tree.leaves[4] + 0.5 * g[at].sum() / (h[at].sum() + 2.0)) < 1e-9


def test_leaf_wise_beats_level_wise_and_losses_are_those_of_score(spark, table):
    train, held = table.where("NOT held"), table.where("held")
    loss = {}
    for growth in ("leaf", "level"):
        m = boosting.fit(train, NAMES, rounds=11, leaves=6, depth=5, rate=0.3, bins=16, growth=growth, held=held)
        assert len(m.trees) == len(m.losses) == 11 and all(len(t.leaves) <= 6 for t in m.trees)
        loss[growth] = m.losses[-1][1]
        y = F.col("target")
        scored = m.score(held).agg(F.avg(-(y * F.log("p_red") + (1 - y) * F.log(1 - F.col("p_red"))))).first()[0]
        # Eleven trees: the margins were written once in between.
        assert abs(scored - loss[growth]) < 1e-9
    assert loss["leaf"] < loss["level"]


def test_boosting_looks_at_weights_and_missing_values(spark):
    rows = [(x, int(x > 0), 1.0) for x in np.linspace(-1, 1, 200).tolist()] + [(None, 1, 1.0)] * 40 + [(float("nan"), 1, 1.0)] * 10 + [(0.5, 0, 0.0)] * 500 + [(0.9, None, 1.0)]
    df = spark.createDataFrame(rows, "x double, target int, w double")
    m = boosting.fit(df, ["x"], weight="w", rounds=5, leaves=4, depth=3, rate=0.5, bins=12)
    p = {r.x: r.p_red for r in m.score(spark.createDataFrame([(-0.9,), (0.9,), (None,), (0.5,)], "x double")).collect()}
    assert p[-0.9] < 0.3 and p[0.9] > 0.8 and p[0.5] > 0.8 and p[None] > 0.5
    assert boosting.fit(df.where("false"), ["x"], rounds=2, edges=[[0.0]]).trees == []


def test_boosting_stops_early(table):
    noise = table.withColumn("target", (F.xxhash64("a") % 2 == 0).cast("int"))
    m = boosting.fit(noise.where("NOT held"), NAMES, rounds=8, leaves=8, depth=3, rate=0.5, bins=8, least_h=0.1, held=noise.where("held"), patience=2)
    held = [b for _, b in m.losses]
    assert len(m.losses) < 8 and (not m.trees or held[len(m.trees) - 1] == min(held))


@pytest.mark.parametrize("drop", [0.0, 0.4])
def test_gradient_equals_finite_differences(drop):
    rng = np.random.default_rng(1)
    sizes = perceptron.shapes(3, 5, 2)
    flat = perceptron.starting(sizes, 1) + 0.1 * rng.normal(size=sum(math.prod(s) for s in sizes))
    x, y, w, key = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.random(20), rng.integers(0, 2**62, 20)
    of = lambda v: perceptron.gradient(perceptron.unpacked(v, sizes), x, y, w, key, 3, drop)
    got = np.concatenate([p.ravel() for p in of(flat)[1]])
    want = [(of(flat + 1e-6 * e)[0] - of(flat - 1e-6 * e)[0]) / 2e-6 for e in np.eye(len(flat))]
    assert np.abs(got - want).max() < 1e-6


def test_sums_do_not_depend_on_partitions(table):
    m = perceptron.Perceptron(NAMES, [0.0] * 4, [1.0] * 4, 6, 1, np.zeros(0))
    flat = perceptron.starting(m.sizes(), 2)
    one, many = (perceptron.added(perceptron.prepared(table.repartition(n), m, "target", "w", None, 1), flat, m.sizes(), 5, 0.3) for n in (1, 6))
    assert np.allclose(one, many, atol=1e-8) and one[-3] == sum(r.w for r in table.collect())
    kept = perceptron.kept(np.arange(20_000), 1, 0, 8, 0.3)
    assert abs((kept > 0).mean() - 0.7) < 0.01 and (kept != perceptron.kept(np.arange(20_000), 2, 0, 8, 0.3)).any()


def test_perceptron_learns_a_product_and_looks_at_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 2))
    rows = [(float(a), float(b), int(a * b > 0), 1.0, i % 5 == 0) for i, (a, b) in enumerate(x)]
    wrong = [(float(a), float(b), int(a * b <= 0), 0.0, False) for a, b in rng.normal(size=(1500, 2))]
    df = spark.createDataFrame(rows + wrong, "a double, b double, target int, w double, held boolean")
    m = perceptron.fit(df.where("NOT held"), ["a", "b"], weight="w", held=df.where("held"), width=16, blocks=1, drop=0.05, epochs=14, batches=2, rate=0.03)
    hit = m.score(df.where("held")).agg(F.avg(((F.col("p_red") > 0.5).cast("int") == F.col("target")).cast("int"))).first()[0]
    assert hit > 0.9 and m.losses[-1][0] < m.losses[0][0]
    odd = m.score(spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (m.mean[0], 1.0)], "a double, b double")).collect()
    assert len({round(r.p_red, 9) for r in odd}) == 1


def surface(p):
    return (p["a"] - 1.3) ** 2 + 2 * (math.log10(p["b"]) + 2) ** 2 + 0.2 * abs(p["c"] - 7) + (p["d"] != "y")


SPACE = {"a": ("float", -5.0, 5.0), "b": ("log", 1e-4, 1.0), "c": ("int", 1, 20), "d": ("choice", ["x", "y", "z"])}


def test_adaptive_search_beats_random_draws():
    wins, gaps = 0, []
    for seed in range(10):
        trials = search.search(surface, SPACE, rounds=15, per_round=4, seed=seed, threads=1)
        rng = random.Random(1000 + seed)
        plain = min(surface(search.any_of(SPACE, rng)) for _ in range(60))
        best = min(s for _, s in trials)
        assert len(trials) == 60 and all(-5 <= p["a"] <= 5 and 1e-4 <= p["b"] <= 1 and p["c"] in range(1, 21) for p, _ in trials)
        wins += best < plain
        gaps.append(plain - best)
    assert wins >= 8 and sum(gaps) > 0


def test_tuner_finds_the_better_penalty(spark):
    rng = random.Random(2)
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", x, int(x + rng.gauss(0, 0.3) > 0)) for i in range(400) for x in [rng.gauss(0, 1)]]
    df = spark.createDataFrame(rows, "bout_id long, d string, x_diff double, target int").withColumn("date", F.to_date("d"))
    # A stand-in model: how far the score is off grows with the distance from 0.1.
    fit_score = lambda train, test, p: test.agg(F.avg(F.abs(F.col("target") - 0.5))).first()[0] + abs(math.log10(p["l2"]) + 1)
    best, trials = search.tune(df, fit_score, {"l2": ("log", 1e-4, 100.0)}, rounds=5, gap_days=1, folds=2, least=(20, 10))
    got = trials.collect()
    assert len(got) == 20 and abs(math.log10(best["l2"]) + 1) < 0.5
    assert min(r.score for r in got[8:]) <= min(r.score for r in got[:8])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_donors_are_a_permutation(n):
    pos = np.arange(n)
    every = [donors.permuted(pos, n, 42, r) for r in range(4)]
    assert all(sorted(e.tolist()) == pos.tolist() for e in every)
    if n >= 1000:
        assert all((e != pos).mean() > 0.99 for e in every) and (every[0] != every[1]).mean() > 0.99
        # No drift: donors of neighbours are as far apart as any two positions.
        assert abs(np.abs(np.diff(every[0])).mean() / (n / 3) - 1) < 0.15


def test_importance_is_that_of_shuffled_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    rows = [(i, float(a), float(b), float(c), int(2 * a + b > 0)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "bout_id long, a_diff double, b_diff double, c_diff double, target int")
    m = models.fit("lr", df)
    got = {r.feature: r["drop"] for r in models.importance(m, df, repeats=6).collect()}
    hit = lambda z: ((2 * z[:, 0] + z[:, 1] > 0) == (2 * x[:, 0] + x[:, 1] > 0)).mean()
    for j, name in enumerate(("a_diff", "b_diff", "c_diff")):
        want = np.mean([1 - hit(np.column_stack([rng.permutation(x[:, k]) if k == j else x[:, k] for k in range(3)])) for _ in range(20)])
        assert abs(got[name] - want) < 0.03
    assert set(got) == {"a_diff", "b_diff", "c_diff"} and got["a_diff"] > got["b_diff"] > 0.05


@pytest.mark.parametrize(("bins", "few"), [(4, 1), (7, 30), (1024, 10_000)])
def test_quantiles_equal_sorting(spark, bins, few):
    rng = np.random.default_rng(6)
    values = [*rng.normal(size=300).tolist(), *[7.0] * 200, *[-0.0, 0.0, 1e300, -1e300, 5e-324], *(10 ** rng.uniform(-9, 9, 100)).tolist()]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    ranks = [0, 1, 150, len(values) // 2, len(values) - 2, len(values) - 1]
    assert donors.order_statistics(df, "v", ranks, bins, few) == [sorted(values)[r] for r in ranks]
    assert donors.exact_quantile(df, "v", 0.5, bins, few) == float(np.median(values))
    assert donors.exact_quantile(df.where("false"), "v", 0.5) is None


def test_ratings_go_on_from_a_snapshot(spark):
    rng = random.Random(8)
    rows = [(i, f"2024-01-{i // 8 + 1:02d}", rng.choice(["Fly", " fly", "light", "heavy"]), a, b, rng.choice([1.0, 0.0, None])) for i in range(160) for a, b in [rng.sample(range(9), 2)]]
    b = spark.createDataFrame(rows, "bout_id long, d string, class string, r_id long, b_id long, red_win double").withColumn("ts", F.to_timestamp("d"))
    want = {(r["class"], r.participant_id): (r.elo, r.bouts) for r in ratings.current_elo(b, ratings.elo_by_class(b), by_class=True).collect()}
    now = lambda s: {(r["class"], r.participant_id): (r.elo, r.bouts) for r in s.collect()}
    same = lambda x, y: x.keys() == y.keys() and all(abs(x[k][0] - y[k][0]) < 1e-9 and x[k][1] == y[k][1] for k in x)
    early = b.where("bout_id < 100 AND NOT (class = 'heavy' AND bout_id > 40)")
    _, state, position = ratings.refresh_by_class(early)
    rated, state2, position2 = ratings.refresh_by_class(b, state, position)
    # Only later bouts are replayed.
    replayed = {r.bout_id for r in rated.collect()}
    assert same(now(state2), want) and replayed == {r[0] for r in rows} - {r.bout_id for r in early.collect()}
    assert ratings.refresh_by_class(b, state2, position2)[0].count() == 0
    # A bout of before the snapshot that comes late: its class is replayed, others are not.
    late = spark.createDataFrame([(999, "2024-01-02", "light", 1, 2, 1.0)], "bout_id long, d string, class string, r_id long, b_id long, red_win double").withColumn("ts", F.to_timestamp("d"))
    more = b.unionByName(late)
    rated, state3, _ = ratings.refresh_by_class(more, state2, position2)
    want = {(r["class"], r.participant_id): (r.elo, r.bouts) for r in ratings.current_elo(more, ratings.elo_by_class(more), by_class=True).collect()}
    assert same(now(state3), want) and rated.count() == more.where("class = 'light'").count()


def test_tuner_readies_each_fold_once(spark, monkeypatch):
    """The rows' weights and scales do not depend on the parameters, and trials over readied folds score as whole fits do;
    in fewer tasks sums are added up in another order, and fits end within their tolerance of each other."""
    rng = random.Random(3)
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", x, 3 * y, int(x + y + rng.gauss(0, 0.5) > 0.4)) for i in range(600) for x, y in [(rng.gauss(0, 1), rng.gauss(0, 1))]]
    df = spark.createDataFrame(rows, "bout_id long, d string, x_diff double, y_diff double, target int").withColumn("date", F.to_date("d"))
    calls, brier = [], lambda d: d.agg(F.avg((F.col("_p") - F.col("target")) ** 2)).first()[0]
    space, how = {"l2": ("log", 1e-3, 1.0), "mix": ("float", 0.0, 1.0)}, {"rounds": 2, "per_round": 2, "gap_days": 1, "folds": 2, "least": (20, 10)}
    of = lambda p: {"regParam": p["l2"], "elasticNetParam": p["mix"], "maxIter": 10}

    def ready(train, test):
        calls.append(1)
        return models.readied(train, test)

    monkeypatch.setattr(search, "TASK_ROWS", 1)
    _, fast = search.tune(df, lambda a, b, p: brier(models.score(models.learner("lr", 2, **of(p)).fit(a), b, "_p")), space, **how, ready=ready)
    _, slow = search.tune(df, lambda a, b, p: brier(models.score(models.fit("lr", a, **of(p)), b, "_p")), space, **how)
    fast, slow = fast.orderBy("trial").collect(), slow.orderBy("trial").collect()
    assert len(calls) == 2 and len(fast) == 4 and [r.params for r in fast] == [r.params for r in slow]
    assert max(abs(a.score - b.score) for a, b in zip(fast, slow, strict=True)) < 1e-9
