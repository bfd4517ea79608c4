"""The tail tracker as keyed state with timers, for rules that an aggregate cannot state.

`live.closed_tail_days` and `live.tail_state` cover the plain case without Python. Here each tail holds, per open day, its
totals and the landings already counted; a timer at the end of the day (on the watermark) gives the closed row out and removes
both. Rows of a tail arrive in any order within the allowed lateness. Needs the RocksDB state store (`staging.session` sets it).
Spark keeps a channel between a task and its Python worker for the state; it must be a Unix domain socket here, which the session is
started with (`spark.python.unix.domain.socket.enabled`), so that no port is opened for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skyledger.streaming.live import LATE_BY, landed_late

OUT = "day date, Tail_Number string, cumul double, legs long, immed double, closed boolean"
DAY_MS = 86_400_000


class TailDays(StatefulProcessor):
    """One tail: day -> (totals, newest landing), and (day, flight) -> seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "cumul double, legs long, immed double, at long, flight string")
        self.seen = handle.getMapState("seen", "day long, flight string, dep long", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changed = set()
        for r in rows:
            day, landing = r.at // (DAY_MS * 1000), (r.at // (DAY_MS * 1000), r.flight_number, r.dep)
            if self.seen.containsKey(landing):
                continue
            self.seen.updateValue(landing, (True,))
            if self.days.containsKey((day,)):
                cumul, legs, immed, at, flight = self.days.getValue((day,))
            else:
                cumul, legs, immed, at, flight = 0.0, 0, 0.0, -1, ""
                self.handle.registerTimer((day + 1) * DAY_MS)
            if (r.at, r.flight_number) >= (at, flight):
                immed, at, flight = r.arr_delay_min, r.at, r.flight_number
            self.days.updateValue((day,), (cumul + r.arr_delay_min, legs + 1, immed, at, flight))
            changed.add(day)
        for day in sorted(changed):
            yield self._row(key, day, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        if self.days.containsKey((day,)):
            yield self._row(key, day, True)
            self.days.removeKey((day,))
            for landing in [k for k in self.seen.keys() if k[0] == day]:
                self.seen.removeKey(landing)

    def _row(self, key, day: int, closed: bool) -> Row:
        cumul, legs, immed, _, _ = self.days.getValue((day,))
        return Row(day=date(1970, 1, 1) + timedelta(days=day), Tail_Number=key[0], cumul=cumul, legs=legs, immed=immed, closed=closed)

    def close(self) -> None:
        pass


def tail_days(polls: DataFrame, *, time: str = "event_time", late_by: str = LATE_BY) -> DataFrame:
    """Tail state in update mode: a row of a tail's day whenever it changes, and a last one, closed, when the day has ended."""
    if polls.sparkSession.sparkContext.getConf().get("spark.python.unix.domain.socket.enabled", "false") != "true":
        raise ValueError("start the session with spark.python.unix.domain.socket.enabled=true")
    landed = landed_late(polls.withWatermark(time, late_by)).select(
        "Tail_Number", "flight_number", "arr_delay_min", time, F.unix_micros(time).alias("at"), F.unix_micros("dep_scheduled").alias("dep"))
    return landed.groupBy("Tail_Number").transformWithState(TailDays(), OUT, "Update", "EventTime")
