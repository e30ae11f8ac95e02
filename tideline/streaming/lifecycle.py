"""The trend lifecycle as a stream: a keyed state processor with event-time timers.

A match's open instances are its only state. Ticks go through the same machine as in batch (``state.Lifecycle``); every
open instance has a timer at the end of its silence. When the watermark passes it and no tick has come, the instance
expires without waiting for the match's next tick. When nothing is open any more the state of the match is removed, so
what is kept follows the live matches, not all that there ever were.

Instances are named by the tick that opened them, which needs no counter in the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.state import Lifecycle
from tideline.registry import query
from tideline.streaming.queries import LATE, drained, stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, event_id long, instance long, trend_type string, state string"
_COLUMNS = ["user_id", "event_id", "instance", "trend_type", "state"]


def tick(m: Lifecycle, row) -> list[tuple[int, str, str]]:  # noqa: ANN001
    """One row through the machine; a new instance is named by the row."""
    m.serial = row.event_id - 1
    return m.tick(row.t // 1_000_000, row.event_type, int(row.event_id % 3) - 1, row.value / 100, row.event_type == m.confirms)


class Instances(StatefulProcessor):
    """Open instances of one match: {type: instance} as JSON, removed when none is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("json", T.StringType())]))

    def _machine(self) -> Lifecycle:
        m = Lifecycle()
        if self.open.exists():
            m.open = json.loads(self.open.get()[0])
        return m

    def _keep(self, m: Lifecycle) -> None:
        wanted = {(held["seen"] + m.expiry + 1) * 1000 for held in m.open.values()}
        known = set(self.handle.listTimers())
        for t in known - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - known:
            self.handle.registerTimer(t)
        if m.open:
            self.open.update((json.dumps(m.open),))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        m, out = self._machine(), []
        # ticks of a trigger in order; a trigger's rows of one match are bounded by maxFilesPerTrigger
        for r in pd.concat(list(rows)).sort_values(["t", "event_id"]).itertuples():
            out += [(key[0], r.event_id, *touched) for touched in tick(m, r)]
        self._keep(m)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        m, out = self._machine(), []
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for kind in sorted(k for k, held in m.open.items() if now - held["seen"] > m.expiry):
            out.append((key[0], -1, m.open.pop(kind)["serial"], kind, "EXPIRED"))
        self._keep(m)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame) -> DataFrame:
    """States of instances from a stream of events with the event time ``at``; event_id is -1 where a timer decided."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("user_id", "event_id", "event_type", "value", F.unix_micros("at").alias("t"), "at").withWatermark("at", LATE)
    return rows.groupBy("user_id").transformWithStateInPandas(Instances(), OUT, "append", "eventTime")


@query("stream_lifecycle")
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-212, O-213: the lifecycle with timers: silent instances expire by the watermark (held against the batch machine in the tests)."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        return drained(lifecycle(stream(spark, sf_dir)))
    finally:
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
