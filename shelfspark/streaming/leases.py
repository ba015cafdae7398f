"""ST-12: reservations of sends over a stream. A lease that nobody finishes is ended by its timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import COOLDOWN_S, LEASE_S, REQUEST, Lease
from ..shipping import ship
from .state import use_rocks

OUT = "uid string, pos long, status string"
#: What a lease that ran out is reported as, without a pos.
EXPIRED = "expired"


class LeaseProcessor(StatefulProcessor):
    """One value a key. Its timer ends a lease that is still held, and later lets go of a key whose cooldown is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "status string, at double, sent double")

    def _keep(self, lease: Lease) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.lease.update((lease.status, lease.at, lease.sent))
        held = lease.status == "sending"
        self.handle.registerTimer(int(((lease.at + LEASE_S) if held else max(lease.at, lease.sent + COOLDOWN_S)) * 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lease = Lease(*self.lease.get()) if self.lease.exists() else Lease()
        for r in sorted(rows, key=lambda r: (r.t, r.pos)):
            yield Row(uid=key[0], pos=r.pos, status=lease.step(float(r.t), r.op, r.sent_elsewhere, r.quota))
        if lease.status is not None:
            self._keep(lease)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lease = Lease(*self.lease.get())
        if lease.status != "sending":
            self.lease.clear()
            return
        lease.status = None
        if lease.sent:
            self._keep(lease)
        else:
            self.lease.clear()
        yield Row(uid=key[0], pos=None, status=EXPIRED)

    def close(self) -> None:
        pass


def stream_reservations(log: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Decisions as ``limits.send_reservations`` makes them, for (uid, t, pos, op, sent_elsewhere, quota); join the directory before, as ``limits.with_sent_elsewhere`` does. Rows of a key must come in order of time across batches. A lease that ran out is a row of its own, EXPIRED, once the clock of the requests, less ``lateness``, has passed it."""
    ship(log.sparkSession)
    use_rocks(log.sparkSession)
    rows = log.select(*[F.col(c) if c in log.columns else F.lit(None).cast("double").alias(c) for c in REQUEST], F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"))
    return rows.withWatermark("ts", lateness).groupBy("uid").transformWithState(statefulProcessor=LeaseProcessor(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
