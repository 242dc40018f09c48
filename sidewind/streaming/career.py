"""Career state as a stream: a row is put out with the state before its bout, then the state moves on."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "participant_id long, bout_id long, wins long, losses long, draws long, win_streak long, loss_streak long, longest long, landed long, attempted long, seconds long"
STATE = "wins long, losses long, draws long, win_streak long, loss_streak long, longest long, landed long, attempted long, seconds long"
FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]


def advance(state: dict, row: dict) -> dict:
    """The state after a bout. Without a winner it leaves the streaks as they are; with ``is_draw`` set, a draw ends both."""
    s = dict(state)
    win, loss, draw = int(row["is_win"]), int(row["is_loss"]), int(row.get("is_draw") or 0)
    s["wins"] += win
    s["losses"] += loss
    s["draws"] += int(not win and not loss)
    if win or loss or draw:
        s["win_streak"] = s["win_streak"] + 1 if win else 0
        s["loss_streak"] = s["loss_streak"] + 1 if loss else 0
    s["longest"] = max(s["longest"], s["win_streak"])
    for c in ("landed", "attempted", "seconds"):
        s[c] += int(row[c])
    return s


class Career(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("career", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        now = dict(zip(FIELDS, known, strict=True)) if known else dict.fromkeys(FIELDS, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "bout_id"])
        out = []
        for row in batch.to_dict("records"):
            out.append({"participant_id": key[0], "bout_id": row["bout_id"], **now})
            now = advance(now, row)
        self.state.update(tuple(now[f] for f in FIELDS))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def career(side_rows: DataFrame) -> DataFrame:
    """side_rows: a stream of side rows; batches must come in time order per participant.

    The processor goes by value: the driver's own Python worker, which sets up its state, does not
    see the files that are shipped to executors.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return side_rows.groupBy("participant_id").transformWithStateInPandas(Career(), OUT, "Append", "None")
