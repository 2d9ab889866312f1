"""The adaptive interval as a streaming operator: state per key across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plover.operators.controller import CALM_EVENTS, CALM_SECONDS, DOWN, LEAST, MOST, START, UP


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    interval, since, clean, changes = state.get if state.exists else (START, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    for at, limited in zip(rows["at"], rows["limited"], strict=True):
        if limited:
            interval, since, clean, changes = min(MOST, interval + UP), int(at), 0, changes + 1
        elif clean + 1 >= CALM_EVENTS and at - since >= CALM_SECONDS:
            interval, since, clean, changes = max(LEAST, interval - DOWN), int(at), 0, changes + 1
        else:
            clean += 1
    state.update((interval, since, clean, changes))
    yield pd.DataFrame({"key": [key[0]], "interval": [interval], "changes": [changes]})


def stream_intervals(events: DataFrame) -> DataFrame:
    """(key, interval, changes) after each micro-batch of a stream of (key, at, event_id, limited).

    Events of one key must arrive in order across batches; within a batch they
    are sorted. A key's batch must fit in memory, its history needn't.
    """
    return events.groupBy("key").applyInPandasWithState(
        _advance, "key long, interval int, changes int", "interval int, since long, clean int, changes int", "update", GroupStateTimeout.NoTimeout
    )
