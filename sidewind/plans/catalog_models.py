"""Queries over the engine's own models: boosting, perceptron, adaptive search, donors, medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, evaluate, models, ratings, scans, search
from ..operators import donors as dn
from ..session import written
from . import bouts as data
from .bouts import BOUTS_SQL, table
from .catalog import ORACLE_SQL, _six, query
from .catalog import _rated as rated_bouts

#: Edges of the bins, so that SQL can cut the same.
EDGES = {"landed_diff": [-110.0, -35.0, 40.0, 115.0], "ctrl_diff": [float(x) for x in range(-80, 81, 10)], "kd_diff": [-1.0, 0.0, 1.0]}


def plain_matrix(spark, d):
    """Decided bouts with differences of the bouts' own measures, which tell the winner; not for prediction."""
    b = data.bouts(spark, d).where("red_win IS NOT NULL")
    return b.select("bout_id", "ts", "date", F.col("red_win").alias("target"), *[(F.col(f"r_{c[:-5]}") - F.col(f"b_{c[:-5]}")).cast("double").alias(c) for c in EDGES], (1.0 + F.col("title")).alias("weight"))


def _tree_sql(l2: float, least: float) -> str:
    """The first tree's splits down to two levels, each by sums over (node, feature, bin)."""
    cells = " UNION ALL ".join(
        f"SELECT bout_id, y, w, {i} AS feature, CAST(1 + {' + '.join(f'CAST({e} < r_{c[:-5]} - b_{c[:-5]} AS INTEGER)' for e in edges)} AS BIGINT) AS bin FROM m" for i, (c, edges) in enumerate(EDGES.items())
    )
    name = "CASE feature " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(EDGES)) + " END"

    def best(k: int) -> str:
        return f"""h{k} AS (SELECT node, feature, bin, sum(w * (p - y)) AS g, sum(w * p * (1 - p)) AS h FROM x JOIN n{k} USING (bout_id) GROUP BY ALL
        ), c{k} AS (SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER (PARTITION BY node, feature) AS gs, sum(h) OVER (PARTITION BY node, feature) AS hs FROM h{k} WINDOW u AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), s{k} AS (SELECT *, round(gl * gl / (hl + {l2}) + (gs - gl) * (gs - gl) / (hs - hl + {l2}) - gs * gs / (hs + {l2}), 9) AS gain FROM c{k} WHERE hl >= {least} AND hs - hl >= {least} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1)"""

    return BOUTS_SQL + f"""m AS (SELECT *, red_win AS y, 1.0 + title AS w, (SELECT sum(red_win * (1.0 + title)) / sum(1.0 + title) FROM bouts WHERE red_win IS NOT NULL) AS p FROM bouts WHERE red_win IS NOT NULL
        ), x AS (SELECT *, (SELECT any_value(p) FROM m) AS p FROM ({cells})), n0 AS (SELECT bout_id, 1 AS node FROM m), {best(0)},
        n1 AS (SELECT bout_id, 2 + CAST(x.bin > s0.bin AS INTEGER) AS node FROM x JOIN s0 USING (feature)), {best(1)}
        SELECT CAST(node AS BIGINT) AS node, {name} AS feature, bin FROM s0 WHERE gain > 0 UNION ALL SELECT CAST(node AS BIGINT), {name}, bin FROM s1 WHERE gain > 0"""


@query("q_boost_first_tree", _tree_sql(1.0, 5.0))
def _(spark, d):
    m = boosting.fit(plain_matrix(spark, d), list(EDGES), weight="weight", rounds=1, leaves=4, depth=2, least_h=5.0, edges=list(EDGES.values()))
    return boosting.splits_of(spark, m).where("feature IS NOT NULL").select("node", "feature", "bin")


@query("q_boost_losses")
def _(spark, d):
    """Loss by round, on training rows and on later ones."""
    rows = written(evaluate.time_split(plain_matrix(spark, d), ["ts", "bout_id"]), "split")
    m = boosting.fit(rows.where("split = 'train'"), list(EDGES), weight="weight", rounds=6, leaves=8, depth=4, held=rows.where("split = 'test'"))
    return spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(m.losses)], "round int, train double, held double")


@query("q_tune_adaptive")
def _(spark, d):
    """Three rounds of four trials of the logistic regression's two penalties, by the Brier score over purged folds."""
    m = plain_matrix(spark, d).drop("weight")

    def fit_score(train, test, p):
        scored = models.score(models.learner("lr", len(EDGES), regParam=p["l2"], elasticNetParam=p["mix"], maxIter=15).fit(train), test, "_p")
        return scored.agg(F.avg((F.col("_p") - F.col("target")) ** 2)).first()[0]

    return search.tune(m, fit_score, {"l2": ("log", 1e-4, 10.0), "mix": ("float", 0.0, 1.0)}, rounds=3, order="date", folds=2, gap_days=2, ready=models.readied)[1]


def _donor_sql(repeats: int, seed: int) -> str:
    """The network in SQL, walked by recursion: positions of customers by number, for each repeat."""
    mask = "(CAST(pow(2, k) AS BIGINT))"
    keys = "(" + " UNION ALL ".join(f"SELECT {r} AS repeat, {', '.join(f'{x} AS k{i}' for i, x in enumerate(dn.keys_of(seed, r)))}" for r in range(repeats)) + ")"
    step = "x // {m} AS l, x % {m} AS r".format(m=mask)
    turn = lambda i, src: f"(SELECT * EXCLUDE (l, r), r AS l, xor(l, ((((r * {dn.MIX} + k{i}) % {dn.PRIME}) * {dn.STRETCH}) // 16) % {mask}) AS r FROM {src})"
    net = lambda src: turn(3, turn(2, turn(1, turn(0, f"(SELECT * EXCLUDE (x), {step} FROM {src})"))))
    return f"""
        WITH RECURSIVE c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer
        ), s AS (SELECT c_custkey, pos, n, CAST(greatest(1, ceil(ceil(log2(greatest(n, 2))) / 2)) AS BIGINT) AS k, pos AS x, q.* FROM c, {keys} q
        ), walk AS (
            SELECT * EXCLUDE (l, r), l * {mask} + r AS x FROM {net("s")}
            UNION ALL
            SELECT * EXCLUDE (l, r), l * {mask} + r AS x FROM {net("(SELECT * FROM walk WHERE x >= n)")}
        )
        SELECT w.c_custkey, CAST(repeat AS INTEGER) AS repeat, d.c_custkey AS donor FROM walk w JOIN c d ON d.pos = w.x WHERE w.x < w.n"""


@query("q_donors", _donor_sql(3, 42))
def _(spark, d):
    """The customer from whom each gets a value in each of three shuffles."""
    rows = scans.positions(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    out = dn.with_donors(rows, rows.count(), ["c_custkey"], seed=42, repeats=3)
    return out.select("c_custkey", "repeat", F.col("_d_c_custkey").alias("donor"))


@query("q_importance")
def _(spark, d):
    """Ten shuffles of each feature of a logistic regression."""
    rows = written(evaluate.time_split(plain_matrix(spark, d).drop("weight"), ["ts", "bout_id"]), "split")
    m = models.fit("lr", rows.where("split = 'train'"))
    return models.importance(m, rows.where("split = 'test'"))


SHARES = [0.0, 0.1, 0.5, 0.999, 1.0]


@query("q_exact_quantiles", " UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, round(CAST(quantile_cont(l_extendedprice, {s}) AS DOUBLE), 6) AS price, round(CAST(quantile_cont(l_quantity, {s}) AS DOUBLE), 6) AS quantity FROM lineitem" for s in SHARES))
def _(spark, d):
    l = table(spark, d, "lineitem")
    found = [(s, *(round(dn.exact_quantile(l, c, s), 6) for c in ("l_extendedprice", "l_quantity"))) for s in SHARES]
    return spark.createDataFrame(found, "share double, price double, quantity double")


@query("q_elo_refresh", ORACLE_SQL["q_elo_current_class"])
def _(spark, d):
    """Current ratings by class from a snapshot of the first half of the bouts and a replay of the others."""
    b = data.bouts(spark, d)
    middle = b.agg(F.percentile_approx(F.unix_seconds(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    _, state, position = ratings.refresh_by_class(rated_bouts(b.where(F.unix_seconds(F.col("ts").cast("timestamp")) <= middle)))
    _, state, _ = ratings.refresh_by_class(rated_bouts(b), state, position)
    return _six(state, "elo").select("class", "participant_id", "elo", "bouts")
