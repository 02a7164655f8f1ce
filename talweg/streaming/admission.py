"""Admission control over a stream of requests: the batch fold with its state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talweg.operators.admission import SESSION_LIMITS, Admission
from talweg.operators.sessions import seconds


def admit_stream(requests: DataFrame, limits=SESSION_LIMITS) -> DataFrame:
    """(event_id, key, ts[, forget]) streaming -> (event_id, key, admitted, wait).

    A key idle for the largest window is forgotten, and so is one when a row with ``forget`` comes, which is no request.
    """
    span = max(s for _, s in limits)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Admission(limits, state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        waits = [own.forget() if forget else own.ask(t) for t, forget in zip(rows.t, rows.forget)]
        state.update((list(own.admitted),))
        state.setTimeoutDuration(span * 1000)
        asked = [w for w in waits if w is not None]
        yield pd.DataFrame({"event_id": rows.event_id[~rows.forget], "key": key[0], "admitted": [w == 0 for w in asked], "wait": asked})

    forget = F.coalesce(F.col("forget"), F.lit(False)) if "forget" in requests.columns else F.lit(False)
    rows = requests.select(F.col("event_id").cast("bigint"), F.col("key").cast("string"), seconds(F.col("ts")).alias("t"), forget.alias("forget"))
    return rows.groupBy("key").applyInPandasWithState(step, "event_id bigint, key string, admitted boolean, wait bigint", "admitted array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
