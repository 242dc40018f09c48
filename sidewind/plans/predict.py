"""The command line for one bout or a file of bouts.

    python -m sidewind.plans.predict SRC RED BLUE [--model ensemble] [--title] [--odds-red -150 --odds-blue 130] [--market-blend 0.3]
    python -m sidewind.plans.predict SRC --card requests.csv

SRC holds the tables of ``bouts``; RED and BLUE are participants' ids. A card is a CSV file with the header
red,blue[,odds_red,odds_blue], of at most CARD rows; a row that cannot be answered says why and does not stop the others.
"""

from __future__ import annotations

import argparse
import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import evaluate, models
from ..session import session, written
from . import bouts as data
from . import features, serve

KINDS = {"lr": ("lr",), "rf": ("rf",), "gbt": ("gbt",), "leaf": ("leaf",), "net": ("net",), "ensemble": models.KINDS}
#: Most bouts of a card, and of a batch.
CARD, BATCH = 15, 10


def trained(spark: SparkSession, src: str, model: str = "lr", params: dict[str, dict] | None = None) -> tuple[dict, dict[str, float], DataFrame]:
    """Fitted and calibrated models, their weights by the validation rows, and all participants' states."""
    sides = data.side_rows(spark, src)
    m = written(evaluate.time_split(features.matrix(data.bouts(spark, src), sides), ["ts", "bout_id"], (0.85, 0.15), ("train", "valid")), "split")
    train, valid = (m.where(F.col("split") == s).drop("split") for s in ("train", "valid"))
    fitted = models.train_all(train, valid, KINDS[model], params)
    names = [f"p_{k}" for k in fitted]
    weights = models.search_weights(models.score_all(fitted, valid), names, tries=500) if len(names) > 1 else {names[0]: 1.0}
    return fitted, weights, written(features.latest_state(sides), "state")


def answers(spark: SparkSession, fitted: dict, weights: dict[str, float], state: DataFrame, requests: list[dict], blend: float = 0.0, most: int = CARD) -> list[dict]:
    """One answer per request {red, blue, odds_red?, odds_blue?}, in order."""
    if len(requests) > most:
        raise ValueError(f"at most {most} bouts at a time")
    if not requests:
        return []
    number = lambda v: None if v in (None, "") else float(v)
    rows = [(i, int(r["red"]), int(r["blue"]), number(r.get("odds_red")), number(r.get("odds_blue"))) for i, r in enumerate(requests)]
    asked = spark.createDataFrame(rows, "request_id int, red long, blue long, odds_red double, odds_blue double")
    out = serve.predict(fitted, asked.select("request_id", "red", "blue"), state, weights).join(asked.select("request_id", "odds_red", "odds_blue"), "request_id")
    out = serve.priced(out)
    p = F.when(F.col("fair_red").isNotNull() & F.lit(blend > 0), sc.blend(F.col("p_red"), F.col("fair_red"), blend)).otherwise(F.col("p_red"))
    out = out.withColumn("p_red", p).withColumns({"p_blue": 1 - F.col("p_red"), "pick": F.when(F.col("error").isNull(), F.when(F.col("p_red") >= 0.5, F.col("red")).otherwise(F.col("blue"))), "confidence": sc.confidence(F.col("p_red"))})
    keep = ("red", "blue", "p_red", "p_blue", "pick", "confidence", "fair_red", "edge_red", "edge_blue", "stake_red", "stake_blue", "error")
    return [{k: r[k] for k in keep if r[k] is not None} for r in out.orderBy("request_id").collect()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sidewind.plans.predict")
    p.add_argument("src")
    p.add_argument("red", nargs="?")
    p.add_argument("blue", nargs="?")
    p.add_argument("--card")
    p.add_argument("--model", choices=sorted(KINDS), default="lr")
    p.add_argument("--odds-red")
    p.add_argument("--odds-blue")
    p.add_argument("--market-blend", type=float, default=0.0)
    a = p.parse_args(argv)
    if a.card:
        with open(a.card, newline="") as f:
            requests = list(csv.DictReader(f))
    elif a.red and a.blue:
        requests = [{"red": a.red, "blue": a.blue, "odds_red": a.odds_red, "odds_blue": a.odds_blue}]
    else:
        p.error("two participants or a card")
    spark = session()
    fitted, weights, state = trained(spark, a.src, a.model)
    found = answers(spark, fitted, weights, state, requests, a.market_blend)
    print(json.dumps(found, indent=2))
    return int(any("error" in r for r in found))


if __name__ == "__main__":
    raise SystemExit(main())
