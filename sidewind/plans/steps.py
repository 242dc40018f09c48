"""The step runner: named steps in order, with subsets, dry runs and a stop at the first failure."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, evaluate, models, ratings
from ..operators.deltas import DeltaTable
from ..operators.dml import next_version, read_latest, versions, write_version
from ..session import session
from . import bouts as data
from . import features, serve

log = logging.getLogger("sidewind")


def _put(df: DataFrame, root: str, sort: list[str] | None = None) -> None:
    """The next version of a table, so that steps can run again and readers of older ones are not disturbed."""
    write_version(df, root, next_version(df.sparkSession, root), sort)


def _bouts(spark, src, out):
    _put(data.bouts(spark, src), f"{out}/bouts", ["ts"])


def _sides(spark, src, out):
    _put(data.side_rows(spark, src), f"{out}/sides", ["participant_id", "ts"])


def _ratings(spark, src, out):
    _put(ratings.elo_global(data.bouts(spark, src)), f"{out}/elo")


def _features(spark, src, out):
    _put(features.matrix(data.bouts(spark, src), data.side_rows(spark, src)), f"{out}/features")


def _split(spark, src, out):
    _put(evaluate.time_split(features.matrix(data.bouts(spark, src), data.side_rows(spark, src)), ["ts", "bout_id"]), f"{out}/split")


def _checks(spark, src, out):
    _put(aggregates.violations(data.bouts(spark, src), data.side_rows(spark, src)), f"{out}/checks")


def _ingest(spark, src, out):
    """Bouts of src as a batch of a delta table: new ones are added, known ones take newer values. The batch's name says what is in
    it, so that the same source applied twice changes nothing."""
    b = data.bouts(spark, src)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.schema)
    n, digest = b.agg(F.count("*"), F.bit_xor(F.xxhash64(*b.columns))).first()
    t = DeltaTable(spark, f"{out}/bouts_delta", schema, ["bout_id"], ("ts",), "coalesce")
    if t.append(b, f"{n}-{(digest or 0) % (1 << 64):016x}"):
        t.compact()


def refresh_ratings(spark: SparkSession, src: str, out: str) -> int:
    """Brings the stored ratings by class up to the bouts of src; returns how many bouts were replayed."""
    at = {k: f"{out}/rating_{k}" for k in ("state", "position")}
    have = all(versions(spark, p) for p in at.values())
    old = [read_latest(spark, p) if have else None for p in at.values()]
    rated, state, position = ratings.refresh_by_class(data.bouts(spark, src), *old)
    _put(state, at["state"])
    _put(position, at["position"])
    return rated.count()


def _predict(spark, src, out):
    """Fits on what is there, and writes a prediction for each participant against the one with the next id."""
    sides = data.side_rows(spark, src)
    m = evaluate.time_split(features.matrix(data.bouts(spark, src), sides), ["ts", "bout_id"], (0.85, 0.15), ("train", "valid"))
    train, valid = (m.where(F.col("split") == k).drop("split") for k in ("train", "valid"))
    state = features.latest_state(sides)
    asked = state.select(F.col("participant_id").alias("request_id"), F.col("participant_id").alias("red"), (F.col("participant_id") + 1).alias("blue"))
    _put(serve.predict(models.train_all(train, valid, ("lr",)), asked, state).where("error IS NULL").drop("error"), f"{out}/predictions")


def health(spark: SparkSession, out: str) -> dict[str, int]:
    """The newest version of each table that the steps write, 0 where there is none yet."""
    names = ["bouts", "sides", "elo", "features", "split", "checks", "rating_state", "rating_position", "predictions"]
    return {n: max(versions(spark, f"{out}/{n}"), default=0) for n in names}


STEPS: list[tuple[str, Callable]] = [("bouts", _bouts), ("sides", _sides), ("ratings", _ratings), ("features", _features), ("split", _split), ("checks", _checks), ("ingest", _ingest), ("refresh ratings", refresh_ratings), ("predict", _predict)]


def run(spark: SparkSession, src: str, out: str, steps: list[int] | None = None, dry: bool = False) -> list[tuple[str, str, float]]:
    """(step, status, seconds) of the chosen steps (1-based); what follows a failure is skipped."""
    done, failed = [], False
    for n, (name, f) in enumerate(STEPS, 1):
        if steps and n not in steps:
            continue
        if dry or failed:
            done.append((name, "dry" if dry else "skipped", 0.0))
            continue
        t = time.time()
        try:
            f(spark, src, out)
            status = "ok"
        except Exception:
            log.exception("step %s failed", name)
            status, failed = "failed", True
        done.append((name, status, time.time() - t))
    return done


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sidewind")
    p.add_argument("src")
    p.add_argument("out")
    p.add_argument("--steps", default="", help="numbers, comma-separated; all if empty")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    rows = run(session(), a.src, a.out, [int(x) for x in a.steps.split(",") if x] or None, a.dry_run)
    for name, status, seconds in rows:
        print(f"{name:10} {status:8} {seconds:7.1f} s")
    return int(any(s == "failed" for _, s, _ in rows))


if __name__ == "__main__":
    raise SystemExit(main())
