"""Rules with a memory and a clock over streams: tries again after a back-off, and notices with a quiet time.

Each key's state is a few numbers in the state store, so that a query goes on after its checkpoint where it stopped,
timers included. The clock is the machines' (clock="ProcessingTime") or the rows' (clock="EventTime", which needs a
watermark on the column `at`; then rows older than it are dropped and timers run as the watermark passes them).
Rows of one key that come in one batch are taken in order of time.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from duespark.streaming.ingest import BACKOFF_HOURS

HOUR = 3_600_000
QUIET_HOURS = 24
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(at: datetime) -> int:
    return int(at.timestamp() * 1000)


def _time(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, UTC)


class Retries(StatefulProcessor):
    """What is to be done with a failed write: wait, try again when its time has come, give up after the last back-off."""

    def __init__(self, hours: tuple[int, ...] = BACKOFF_HOURS):
        self.hours = hours

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempts int, due bigint")

    def _wait(self, key, attempts: int, at: int):
        due = at + self.hours[attempts] * HOUR
        self.open.update((attempts, due))
        self.handle.registerTimer(due)
        return Row(id=key[0], action="wait", attempts=attempts, at=_time(due))

    def _close(self) -> int:
        attempts, due = self.open.get()
        self.handle.deleteTimer(due)
        self.open.clear()
        return attempts

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: (r["at"], r["ok"])):
            at = _millis(row["at"])
            if row["ok"]:
                if self.open.exists():
                    yield Row(id=key[0], action="done", attempts=self._close(), at=row["at"])
            elif not self.open.exists():
                yield self._wait(key, 0, at)
            else:
                attempts = self._close() + 1
                if attempts < len(self.hours):
                    yield self._wait(key, attempts, at)
                else:
                    yield Row(id=key[0], action="give up", attempts=attempts, at=row["at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.open.exists():
            attempts, due = self.open.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                yield Row(id=key[0], action="try again", attempts=attempts, at=_time(due))


def retries(outcomes: DataFrame, clock: str = "ProcessingTime", hours: tuple[int, ...] = BACKOFF_HOURS) -> DataFrame:
    """STM-08: id, action, attempts, at, from a stream of outcomes of writes (id string, at timestamp, ok boolean).

    A first failure waits for the first back-off ("wait": until when). When it is over, "try again" asks for one more
    try, whose outcome comes back in the stream: a success ends it ("done"), a failure waits for the next back-off, and
    after as many failed tries as there are back-offs it is given up ("give up"). A success without a failure is nothing.
    """
    return outcomes.groupBy("id").transformWithState(Retries(hours), "id string, action string, attempts int, at timestamp", "Append", clock)


class Notices(StatefulProcessor):
    """Which notices go out: the first of a key, and the next that comes over the quiet time after the last that went out."""

    def __init__(self, hours: int = QUIET_HOURS):
        self.quiet = hours * HOUR

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: r["at"]):
            at = _millis(row["at"])
            last = self.last.get()[0] if self.last.exists() else None
            if last is not None and at - last <= self.quiet:
                yield Row(key=key[0], at=row["at"], sent=False, skipped="duplicate_within_24h")
                continue
            if not row["failed"]:
                if last is not None:
                    self.handle.deleteTimer(last + self.quiet + 1)
                self.last.update((at,))
                self.handle.registerTimer(at + self.quiet + 1)
            yield Row(key=key[0], at=row["at"], sent=True, skipped=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        # The quiet time is over, so the key needs no memory.
        if self.last.exists() and self.last.get()[0] + self.quiet < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])


def notices(requests: DataFrame, clock: str = "ProcessingTime", hours: int = QUIET_HOURS) -> DataFrame:
    """STM-07, WIN-12: key, at, sent, skipped, from a stream of requests (key string, at timestamp, failed boolean).

    A request within the quiet time after the last notice of its key that went out is skipped. One that goes out but
    can't be delivered (failed) starts no quiet time. A key's state is dropped when its quiet time is over.
    """
    return requests.groupBy("key").transformWithState(Notices(hours), "key string, at timestamp, sent boolean, skipped string", "Append", clock)
