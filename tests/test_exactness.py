"""Windows, names, versions, ratings and streams against direct computations, where a fixed bound or a torn write would show."""

import difflib
import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sidewind import session
from sidewind.functions import text
from sidewind.operators import alike, dml, joins, models, ratings
from sidewind.operators import windows as w
from sidewind.plans import features, streams
from sidewind.plans.bouts import bouts, side_rows
from sidewind.streaming import ingest


@pytest.mark.parametrize("span", [1, 5, 100])
def test_ewma_equals_pandas_at_any_span(spark, span):
    rng = random.Random(1)
    values = [rng.random() for _ in range(400)]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "participant_id long, ts long, bout_id long, v double")
    got = {r.ts: r.e for r in df.select("ts", w.ewma(F.col("v"), span).alias("e")).collect()}
    want = pd.Series(values).ewm(span=span).mean().shift(1)
    assert got[0] is None and all(abs(got[i] - want[i]) < 1e-12 for i in range(1, 400))


def test_parsers_read_the_loose_forms(spark):
    df = spark.createDataFrame([("5 of 10 (50%)", "May 30 2026", "U-DEC", "72", "6'", "x")], "o string, d string, m string, r string, h string, c string")
    r = df.select(text.x_of_y(F.col("o")).alias("o"), text.month_date(F.col("d")).cast("string").alias("d"), text.method_of(F.col("m")).alias("m"), text.reach_cm(F.col("r")).alias("r"), text.height_cm(F.col("h")).alias("h"), text.elapsed_seconds(F.lit(3), F.col("c")).alias("c")).first()
    assert (tuple(r.o), r.d, r.m, r.r, r.h, r.c) == ((5, 10), "2026-05-30", "Decision - Unanimous", 182.9, None, 0)
    codes = {"S-DEC": "Split", "M-DEC": "Majority", "dec": "Unanimous", "Decision - Majority": "Majority", "unanimous": "Unanimous"}
    rows = spark.createDataFrame([(c,) for c in codes], "m string").select("m", text.method_of(F.col("m")).alias("x")).collect()
    assert {r.m: r.x for r in rows} == {c: f"Decision - {n}" for c, n in codes.items()}


@pytest.mark.parametrize("cutoff", [0.6, 0.8, 0.9])
def test_closest_without_blocks_misses_no_name(spark, cutoff):
    rng = random.Random(5)
    base = ["".join(rng.choices("aabcdeeilmnorst ", k=rng.randint(3, 14))) for _ in range(60)]
    names = [*base[:30], *("".join(c if rng.random() > 0.15 else rng.choice("xyz") for c in b) for b in base), ""]
    got = {r.name: r.score for r in joins.closest(spark.createDataFrame([(n,) for n in set(names)], "name string"), spark.createDataFrame([(b,) for b in set(base)], "candidate string"), cutoff=cutoff).collect()}
    for n in set(names):
        best = max(difflib.SequenceMatcher(None, n, b).ratio() for b in base)
        assert got[n] == (best if best >= cutoff else None)


def test_ingest_goes_on_after_a_torn_batch(spark, tmp_path):
    root = f"{tmp_path}/table"
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k")
    rows(0, 5).write.parquet(f"{tmp_path}/in/1")
    source = lambda: ingest.stream(spark, f"{tmp_path}/in/*", "k long")
    table = ingest.delta_table(spark, root, rows(0, 1), ["k"])
    ingest.ingest(source(), root, ["k"], f"{tmp_path}/checkpoint").awaitTermination()
    # A writer that died: files without the mark of success.
    name = table.batches()[1]
    shutil.copytree(f"{root}/deltas/_batch=00000001~{name}", f"{root}/deltas/_batch=00000002~{name[:-1]}1", ignore=shutil.ignore_patterns("_SUCCESS"))
    assert list(table.batches()) == [1] and list(table.batches(torn=True)) == [1, 2]
    rows(3, 9).write.parquet(f"{tmp_path}/in/2")
    ingest.ingest(source(), root, ["k"], f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.k for r in table.read().collect()) == list(range(9))
    assert list(table.batches()) == [1, 3]


def test_streams_read_tables_that_are_folders(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    as_folder, as_file = (sorted(map(tuple, streams.stream_counts(spark, d).collect())) for d in (str(tmp_path), sf))
    assert as_folder == as_file and as_file


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    assert session.shared_root(spark)

    class Far:
        conf, sparkContext = {}, type("C", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Far)


def test_glicko_idle_and_class_spelling(spark):
    r, rd, sigma = 1600.0, 349.9, 0.06
    for _ in range(400):
        r, rd, sigma = ratings.glicko_update(r, rd, sigma, [])
    assert r == 1600.0 and rd > 350
    rows = [(1, "2024-01-05", "Fly", 1, 2, 1), (2, "2024-05-05", " fly", 1, 3, 0), (3, "2024-08-05", None, 1, 2, None)]
    df = spark.createDataFrame(rows, "bout_id long, ts string, class string, r_id long, b_id long, red_win int").withColumn("ts", F.to_timestamp("ts"))
    now = {(x["class"], x.participant_id): x for x in ratings.current_glicko(df).collect()}
    assert set(now) == {("fly", 1), ("fly", 2), ("fly", 3), ("", 1), ("", 2)}
    before = {x.bout_id: x for x in ratings.glicko_by_class(df).collect()}
    assert before[2].r_rating > 1500 and now["fly", 3].rating > 1500 > now["fly", 2].rating
    elo = {(x["class"], x.participant_id): x for x in ratings.current_elo(df, ratings.elo_by_class(df), by_class=True).collect()}
    assert elo["fly", 1].bouts == 2 and elo["", 1].elo == 1400


def test_idle_in_training_and_serving(spark):
    rows = [(1, d, i) for i, d in enumerate(("2024-01-01", "2024-01-11", "2024-02-10"))] + [(2, "2024-01-01", 0)]
    s = spark.createDataFrame(rows, "participant_id long, date string, bout_id long").withColumn("date", F.to_date("date")).withColumn("ts", F.col("date").cast("timestamp"))
    zero = {c: F.lit(0) for c in ("is_win", "is_loss", "landed", "attempted", "td_landed", "td_attempted", "seconds", "opp_landed", "opp_attempted", "opp_td_landed", "opp_td_attempted", "opp_kd", "title")}
    s = s.withColumns({**zero, "method": F.lit(""), "class": F.lit(""), "side": F.lit("r")})
    before = {(r.participant_id, r.bout_id): r.idle for r in features.long_features(s).collect()}
    assert before == {(1, 0): 20.0, (1, 1): 10.0, (1, 2): 30.0, (2, 0): 20.0}
    now = {r.participant_id: r.idle for r in features.latest_state(s, as_of=F.to_date(F.lit("2024-03-01"))).collect()}
    assert now == {1: 20.0, 2: 60.0}


def test_tuner_and_finish_model(spark):
    rng = random.Random(2)
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", x, int(x + rng.gauss(0, 0.3) > 0), ("KO/TKO", "Submission", "Decision - Split")[0 if y > 0.5 else 1 if y < -0.5 else 2], y) for i in range(600) for x, y in [(rng.gauss(0, 1), rng.gauss(0, 1))]]
    m = spark.createDataFrame(rows, "bout_id long, date string, a_diff double, target int, method string, b_diff double").withColumn("date", F.to_date("date"))
    best, all_scores = models.tune(m.drop("method"), "lr", [{"regParam": 5.0}, {"regParam": 0.001}], gap_days=1, least=(20, 10))
    assert best == {"regParam": 0.001} and all_scores.count() == 10
    f = models.finish_rows(m.drop("method"), m.select("bout_id", "method"))
    out = models.score_finish(models.fit_finish(f), f)
    r = out.agg(F.avg((F.col("finish") == F.col("finish_pick")).cast("int")).alias("hit"), F.max(F.abs(F.col("p_ko") + F.col("p_sub") + F.col("p_dec") - 1)).alias("off")).first()
    assert r.hit > 0.6 and r.off < 1e-9


def test_matrix_still_covers_all_decided_bouts(spark, sf):
    b = bouts(spark, sf)
    assert features.matrix(b, side_rows(spark, sf), debuts=True).count() == b.where("red_win IS NOT NULL").count()


def _odd_names(rng, n, key):
    """Names of few letters in few blocks: empty, missing and equal ones, long ones of popular letters, letters of several bytes."""
    short = lambda: "".join(rng.choices("abcé日", k=rng.randint(0, 7)))
    pool = [None, *[short() for _ in range(30)], *["".join(rng.choices("ab", k=k)) for k in (63, 64, 65, 198, 220)], "ab" * 120]
    return [(rng.choice([0.0, -0.0, 2.0, float("nan"), None]), i, rng.choice(pool), rng.choice(pool)) for i in range(n)], f"g double, {key} long, a string, b string"


def _blocks(rows):
    out = {}
    for g, i, a, b in rows:
        if g is not None:
            out.setdefault(str(g + 0.0), []).append((i, a or "", b or ""))
    return out


def _ratio(x, y):
    return difflib.SequenceMatcher(None, x, y).ratio()


@pytest.mark.parametrize("chunk", [(256, 8192), (5, 7)])
def test_best_match_equals_all_pairs(spark, monkeypatch, chunk):
    rng = random.Random(11)
    monkeypatch.setattr(alike, "LEFT", chunk[0])
    monkeypatch.setattr(alike, "RIGHT", chunk[1])
    (l, ls), (r, rs) = _odd_names(rng, 70, "id"), _odd_names(rng, 70, "rid")
    got = {x.id: (x.score, x.rid) for x in joins.best_match(spark.createDataFrame(l, ls), spark.createDataFrame(r, rs), ["g"], (0.6, 0.3)).collect()}
    want = {}
    for g, mine in _blocks(l).items():
        for i, a, b in mine:
            pairs = [(_ratio(a, c), _ratio(b, d), -j) for j, c, d in _blocks(r).get(g, [])]
            found = [(x + y, j) for x, y, j in pairs if max(x, y) >= 0.6 and min(x, y) >= 0.3 and x + y > 1.0]
            if found:
                want[i] = (max(found)[0], -max(found)[1])
    assert got == want and len(want) > 20


def test_few_pairs_of_a_block_are_compared_in_full(monkeypatch):
    """Of 1.6 million pairs about one for each name."""
    calls, real = [], alike.ratio
    monkeypatch.setattr(alike, "ratio", lambda x, y: (calls.append(1), real(x, y))[1])
    names = [[f"Name#{7 * i:09d}"] for i in range(1200)]
    found = list(alike.best_in((0.8, 0.8), -1.0)([[n[0] + "x"] for n in names[:400]], names))
    assert [f[:2] for f in found] == [(i, i) for i in range(400)] and len(calls) < 2000


@pytest.mark.parametrize("chunk", [(512, 8192), (5, 7)])
def test_fuzzy_pairs_equal_all_pairs(spark, monkeypatch, chunk):
    rng = random.Random(12)
    monkeypatch.setattr(alike, "LEFT", chunk[0])
    monkeypatch.setattr(alike, "RIGHT", chunk[1])
    (l, ls), (r, rs) = _odd_names(rng, 80, "id"), _odd_names(rng, 80, "rid")
    got = {x.id: (x.reversed, x.rid, x.score) for x in joins.fuzzy_pairs(spark.createDataFrame(l, ls), spark.createDataFrame(r, rs), ["g"], 0.5).collect()}
    want = {}
    for g, mine in _blocks(l).items():
        for i, a, b in mine:
            pairs = [(min(_ratio(a, c), _ratio(b, d)), min(_ratio(a, d), _ratio(b, c)), j) for j, c, d in _blocks(r).get(g, [])]
            found = [(x < 0.5, j, max(x, y)) for x, y, j in pairs if max(x, y) >= 0.5]
            if found:
                want[i] = min(found)
    assert got == want and len({f for f, _, _ in want.values()}) == 2


def test_first_pair_of_a_block_is_found_with_few_in_full(monkeypatch):
    """Of half a million pairs a few for each name."""
    calls, real = [], alike.ratio
    monkeypatch.setattr(alike, "ratio", lambda x, y: (calls.append(1), real(x, y))[1])
    names = [(f"name#{97 * i:09d}", f"Name#{97 * i:09d}") for i in range(1200)]
    found = list(alike.first_in(0.85)(names[:400], [(b, a) for a, b in names]))
    assert len(found) == 400 and all(j <= i for i, j, _, _ in found) and len(calls) < 20 * 400


@pytest.mark.parametrize("chunk", [(512, 8192), (5, 7)])
def test_closest_in_blocks_equals_all_pairs(spark, monkeypatch, chunk):
    rng = random.Random(13)
    monkeypatch.setattr(alike, "LEFT", chunk[0])
    monkeypatch.setattr(alike, "RIGHT", chunk[1])
    (l, ls), (r, rs) = _odd_names(rng, 60, "id"), _odd_names(rng, 60, "rid")
    names, candidates = spark.createDataFrame(l, ls).select("g", F.col("a").alias("name")), spark.createDataFrame(r, rs).select("g", F.col("a").alias("candidate"))
    got = sorted(((x.name, x.match, x.score) for x in joins.closest(names, candidates, F.col("g"), F.col("g"), 0.6).collect()), key=repr)
    of, best = lambda rows: [(str(g + 0.0), a) for g, _, a, _ in rows if g is not None], {}
    for g, n in of(l):
        pairs = [(_ratio(n, c or ""), c is not None, c) for k, c in of(r) if k == g] if n is not None else []
        best[n] = max([p for p in pairs if p[0] >= 0.6] + [best.get(n, (0.0, False, ""))], key=lambda p: (p[0], p[1], p[2] or ""))
    want = sorted(((n, *((best[n][2], best[n][0]) if best.get(n, (0.0,))[0] else (None, None))) for _, _, n, _ in l), key=repr)
    assert got == want and sum(m is not None for _, m, _ in want) > 20


def test_a_small_block_table_is_dealt_over_tasks(spark):
    """Few bytes are much work: adaptive execution must not put them into one task."""
    n = spark.range(3000).select(F.struct((F.col("id") % 100).alias("k0")).alias("_k"), F.array(F.format_string("Name#%09d", "id")).alias("_names"), F.col("id").alias("_pick"))
    found = alike.match(n.select("_k", "_names"), n, alike.best_in((0.8, 0.8), -1.0), F.asc("_pick"))
    assert found.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
