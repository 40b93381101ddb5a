"""The scalar filter over a stream of events: a user's state is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "user_id long, n long, mean double, var double"


def advance(values, state: tuple[int, float, float] | None, a: float, q: float, r: float) -> tuple[int, float, float]:
    """(steps, mean, variance) after ``values`` in order; a null value is a step without an observation."""
    n, mean, var = state or (0, 0.0, 0.0)
    for x in values:
        mean, var = (a * mean, a * a * var + q) if n else (0.0, q / (1 - a * a))
        if not pd.isna(x):
            gain = var / (var + r)
            mean, var = mean + gain * (x - mean), (1 - gain) * var
        n += 1
    return n, mean, var


def filter_stream(events: DataFrame, a: float = 0.85, q: float = 0.1, r: float = 0.4) -> DataFrame:
    """``events``: user_id, ts (timestamp), event_id, x -> the state of each user that a batch touched.

    Events of a user must come in order from batch to batch; within a batch they are put in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        new = advance(rows["x"], tuple(state.get) if state.exists else None, a, q, r)
        state.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["user_id", "n", "mean", "var"])

    return events.groupBy("user_id").applyInPandasWithState(step, SCHEMA, "n long, mean double, var double", "update", GroupStateTimeout.NoTimeout)
