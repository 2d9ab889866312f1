"""An adaptive collection interval, folded over each key's events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes: start, step up at a rate limit, step down after a calm spell, bounds.
START, UP, DOWN, LEAST, MOST = 15, 4, 2, 5, 60
#: A calm spell: so many seconds and clean events since the last change.
CALM_SECONDS, CALM_EVENTS = 24 * 3600, 6


def intervals(events: DataFrame) -> DataFrame:
    """(key, interval, changes) from rows (key, at in seconds, event_id, limited).

    The state depends on the order of events, so it is a fold; a key's events
    must fit in one row. For unbounded keys use `plover.streaming.controller`,
    which keeps the same state across micro-batches.
    """
    rows = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "limited"))).alias("rows"))
    fold = f"""aggregate(rows, named_struct('interval', {START}, 'since', 0L, 'clean', 0, 'changes', 0), (s, e) ->
        if(e.limited, named_struct('interval', least({MOST}, s.interval + {UP}), 'since', e.at, 'clean', 0, 'changes', s.changes + 1),
        if(s.clean + 1 >= {CALM_EVENTS} and e.at - s.since >= {CALM_SECONDS},
            named_struct('interval', greatest({LEAST}, s.interval - {DOWN}), 'since', e.at, 'clean', 0, 'changes', s.changes + 1),
            named_struct('interval', s.interval, 'since', s.since, 'clean', s.clean + 1, 'changes', s.changes))))"""
    return rows.withColumn("s", F.expr(fold)).select("key", "s.interval", "s.changes")
