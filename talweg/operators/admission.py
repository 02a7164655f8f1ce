"""Admission control with several sliding windows. Only admitted requests count against later ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.operators.sessions import seconds

#: (requests, seconds): per session and, three times as much, per address.
SESSION_LIMITS = ((10, 60), (200, 86_400))
ADDRESS_LIMITS = tuple((3 * n, s) for n, s in SESSION_LIMITS)


class Admission:
    """The state of one key: the times of its admitted requests within the largest window."""

    def __init__(self, limits, admitted=()):
        self.limits = sorted(limits, key=lambda x: x[1])
        self.admitted = deque(admitted)

    def forget(self) -> None:
        """As if the key had never asked."""
        self.admitted.clear()

    def ask(self, now: float) -> int:
        """0 if admitted, else the seconds to wait. The shortest window that is full decides."""
        while self.admitted and now - self.admitted[0] > self.limits[-1][1]:
            self.admitted.popleft()
        for most, span in self.limits:
            inside = [t for t in self.admitted if now - t <= span]
            if len(inside) >= most:
                return max(1, int(span - (now - inside[0])) + 1)
        self.admitted.append(now)
        return 0


def admit(requests: DataFrame, limits=SESSION_LIMITS) -> DataFrame:
    """(event_id, key, ts) -> (event_id, key, admitted, wait).

    Whether a request passes depends on which earlier ones did, so a key is a sequence. Keys are dealt over the
    partitions and sorted by the shuffle; the fold streams and holds one key's window, never its history.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            waits = []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if state is None or k != key:
                    key, state = k, Admission(limits)
                waits.append(state.ask(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w == 0 for w in waits], pa.bool_()), pa.array(waits, pa.int64())], ["event_id", "key", "admitted", "wait"])

    rows = requests.select(F.col("event_id").cast("bigint"), F.col("key").cast("string"), seconds(F.col("ts")).alias("t"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInArrow(run, "event_id bigint, key string, admitted boolean, wait bigint")


def admit_in_turn(requests: DataFrame, first: str, then: str, first_limits=ADDRESS_LIMITS, then_limits=SESSION_LIMITS) -> DataFrame:
    """Two levels: what the first key's limits admit is asked of the second's; the first budget is used up either way."""
    one = admit(requests.withColumn("key", F.col(first)), first_limits)
    passed = requests.join(one.filter("admitted").select("event_id"), "event_id", "left_semi")
    two = admit(passed.withColumn("key", F.col(then)), then_limits)
    status = F.when(~F.col("a.admitted"), first).when(~F.col("b.admitted"), then)
    return one.alias("a").join(two.alias("b"), "event_id", "left").select("event_id", status.isNull().alias("admitted"), status.alias("refused_by"), F.coalesce(F.when(~F.col("a.admitted"), F.col("a.wait")), F.col("b.wait")).alias("wait"))
