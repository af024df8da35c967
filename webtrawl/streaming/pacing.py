"""Rate-limited start times for fetches as they arrive."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webtrawl.functions.times import MICROS
from webtrawl.operators.pacing import MAX_FETCHES, WINDOW_SECONDS, last_admitted, paced_schedule
from webtrawl.sources.changes import ChangeTable
from webtrawl.sources.scratch import materialize
from webtrawl.streaming.run import Handler, keep_state_in_rocksdb

ADMITTED = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("at", T.LongType()),
    ]
)


def pacing_handler(
    admitted: ChangeTable,
    schedule: ChangeTable,
    tie: str,
    window_seconds: int = WINDOW_SECONDS,
    limit: int = MAX_FETCHES,
) -> Handler:
    """Handles a batch of arrivals (root, ts and the columns of ``schedule``).

    All that a later batch must know of a root are its last ``limit`` starts,
    and these are the state.  A batch is planned by the same set operations as a
    whole log, so a root with most of the arrivals spreads over the cluster,
    which a state machine run root by root would not let it do.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        arrivals = materialize(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "arrivals")
        known = admitted.current(batch_id)
        planned = materialize(
            paced_schedule(arrivals, tie, window_seconds, limit, admitted=known), "planned"
        )
        # Every slot of a root that moved is written again; the others stay as they were.
        moved = known.join(planned.select("root").distinct(), "root", "left_semi")
        admitted.write(last_admitted(planned, moved, limit), batch_id)
        schedule.write(planned, batch_id)

    return handle


class PacedRoot(StatefulProcessor):
    """The last starts of one root, and its arrivals that the watermark has not passed.

    An arrival is planned when no earlier one can come any more, so that the plan
    is in the order of the whole log.  One timer at a time waits for the earliest
    arrival, and plans all that the watermark has passed by then.
    """

    def __init__(self, window: int, limit: int, tie: str):
        self.window, self.limit, self.tie = window, limit, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", "at bigint")
        self.waiting = handle.getListState("waiting", f"at bigint, tie {self.tie}")
        self.earliest = handle.getValueState("earliest", "at bigint")

    def _wait_for(self, at: int) -> None:
        self.earliest.update((at,))
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = [(r.at, r.tie) for r in rows]
        self.waiting.appendList(arrived)
        first, known = min(at for at, _ in arrived), self.earliest.get()
        if known is None or first < known[0]:
            self._wait_for(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.earliest.get()
        if known is None or known[0] > passed:
            return
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1]))
        later = [r for r in waiting if r[0] > passed]
        last = deque((at for (at,) in self.starts.get()), self.limit)
        for at, tie in waiting[: len(waiting) - len(later)]:
            start = max(at, last[0] + self.window) if len(last) == self.limit else at
            last.append(start)
            yield Row(root=key[0], tie=tie, at=at, start=start)
        self.starts.put([(at,) for at in last])
        if later:
            self.waiting.put(later)
            self._wait_for(later[0][0])
        else:
            self.waiting.clear()
            self.earliest.clear()

    def close(self) -> None:
        pass


def paced_stream(
    arrivals: DataFrame,
    tie: str,
    window_seconds: int = WINDOW_SECONDS,
    limit: int = MAX_FETCHES,
    late: str = "10 seconds",
) -> DataFrame:
    """(root, tie, ts, start_ts, delay_us): the schedule of a stream of (root, ts, tie).

    The rows of ``paced_schedule`` over the whole log, each once the watermark has
    passed its ts, as long as no arrival is later than ``late``.  What is kept of
    a root are its last ``limit`` starts and the arrivals since the watermark.
    Rows without ts are left out; a null root is a root.

    A root's arrivals go through one task.  Where one root has most of them,
    :func:`pacing_handler` plans the same in batches that spread over the cluster.
    """
    keep_state_in_rocksdb(arrivals.sparkSession)
    # A slot is free only when more than the window has passed.
    window = window_seconds * MICROS + 1
    rows = (
        arrivals.where(F.col("ts").isNotNull())
        .withWatermark("ts", late)
        .select("root", "ts", F.unix_micros("ts").alias("at"), F.col(tie).alias("tie"))
    )
    kind = rows.schema["tie"].dataType.simpleString()
    planned = rows.groupBy("root").transformWithState(
        statefulProcessor=PacedRoot(window, limit, kind),
        outputStructType=f"root string, tie {kind}, at bigint, start bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return planned.select(
        "root",
        F.col("tie").alias(tie),
        F.timestamp_micros("at").alias("ts"),
        F.timestamp_micros("start").alias("start_ts"),
        (F.col("start") - F.col("at")).alias("delay_us"),
    )
