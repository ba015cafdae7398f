"""ST-11, ST-14: the lookup budget over a stream of requests. A user's state is 100 times and 30 addresses at most, and goes when the user has been idle for a day."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import DAY_S, Budget
from ..shipping import ship
from .state import use_rocks

OUT = "uid string, pos long, accepted boolean, charged long"


class BudgetProcessor(StatefulProcessor):
    """Times are list state, one value each; addresses with the time of their last change are a value. One timer a user, at the end of the day after the last accepted request, clears both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double")
        self.seen = handle.getValueState("seen", "addresses array<string>, at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        b = Budget()
        b.times.extend(t for (t,) in self.times.get())
        if self.seen.exists():
            addresses, b.seen_at = self.seen.get()
            b.seen = list(addresses)
        last = b.times[-1] if b.times else None
        for r in sorted(rows, key=lambda r: (r.t, r.pos)):
            ok, n = b.ask(float(r.t), [a for a in (r.addresses or []) if a])
            yield Row(uid=key[0], pos=r.pos, accepted=ok, charged=n)
        if b.times and b.times[-1] != last:
            self.times.put([(t,) for t in b.times])
            self.seen.update((b.seen, b.seen_at))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((b.times[-1] + DAY_S) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_budget(requests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Decisions as ``limits.lookup_budget`` makes them, for (uid, t in seconds, pos, addresses). Requests of a user must come in order of time across
    batches; within one they are sorted. The clock is that of the requests: a user's state goes once the latest time of all, less
    ``lateness``, is a day after the user's last accepted request."""
    ship(requests.sparkSession)
    use_rocks(requests.sparkSession)
    rows = requests.select("uid", "t", "pos", "addresses", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts")).withWatermark("ts", lateness)
    return rows.groupBy("uid").transformWithState(statefulProcessor=BudgetProcessor(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
