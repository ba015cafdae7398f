"""Budgets and leases: folds over one user's requests in order, since what was accepted counts against what follows.

A user's whole log is never gathered: requests are dealt to users' groups and replayed as a stream
of Arrow batches, sorted by user and time, with the state of one user at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship

SHORT_S, SHORT_LIMIT, DAY_S, DAY_LIMIT, SEEN_S, SEEN_KEPT = 600, 30, 86_400, 100, 600, 30
COOLDOWN_S, LEASE_S = 3_600, 600


class Budget:
    """ST-11 for one user. A request of several addresses is accepted or rejected whole; addresses seen within ten minutes of the last change are free."""

    def __init__(self):
        self.times: deque = deque()
        self.seen: list[str] = []
        self.seen_at = float("-inf")

    def ask(self, now: float, addresses: list[str]) -> tuple[bool, int]:
        """(accepted, charged)."""
        if now - self.seen_at >= SEEN_S:
            self.seen = []
        fresh = [a for a in dict.fromkeys(addresses) if a not in self.seen]
        if not fresh:
            return True, 0
        while self.times and now - self.times[0] >= DAY_S:
            self.times.popleft()
        short = sum(now - t < SHORT_S for t in self.times)
        if short + len(fresh) > SHORT_LIMIT or len(self.times) + len(fresh) > DAY_LIMIT:
            return False, 0
        self.times.extend([now] * len(fresh))
        self.seen = [*self.seen, *fresh][-SEEN_KEPT:]
        self.seen_at = now
        return True, len(fresh)


def replay(log: DataFrame, start, schema: str) -> DataFrame:
    """(uid, t, pos, ...) -> rows of ``start()(t, row)`` in each user's order."""
    ship(log.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid, state = object(), None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.uid != uid:
                    uid, state = row.uid, start()
                out.append(state(row))
            yield pd.DataFrame(out)

    return log.repartition("uid").sortWithinPartitions("uid", "t", "pos").mapInPandas(run, schema)


def lookup_budget(requests: DataFrame) -> DataFrame:
    """ST-11, ST-14: (uid, t in seconds, pos, addresses) -> (uid, pos, accepted, charged). State is bounded: 100 times and 30 addresses a user."""

    def start():
        b = Budget()

        def one(row):
            ok, n = b.ask(float(row.t), [a for a in (row.addresses if row.addresses is not None else []) if a])
            return {"uid": row.uid, "pos": row.pos, "accepted": ok, "charged": n}

        return one

    return replay(requests.select("uid", "t", "pos", "addresses"), start, "uid string, pos long, accepted boolean, charged long")


class Lease:
    """ST-12 for one address of one owner: status, when it was set, and when it was last sent to."""

    def __init__(self, status: str | None = None, at: float = 0.0, sent: float = 0.0):
        self.status, self.at, self.sent = status, at, sent

    def reserve(self, now: float, sent_elsewhere: float | None = None, quota: int | None = None) -> str:
        """cooldown, sending (another run has the lease), quota (nothing can be sent today), or reserved. What another source knows to have been sent counts too."""
        sent = max(self.sent, sent_elsewhere or 0.0)
        if sent and now - sent < COOLDOWN_S:
            return "cooldown"
        if self.status == "sending" and now - self.at < LEASE_S:
            return "sending"
        if quota is not None and quota < 1:
            return "quota"
        self.status, self.at, self.sent = "sending", now, sent
        return "reserved"

    def finish(self, now: float, op: str) -> str:
        """sent or failed; what failed may be tried again at once."""
        self.status, self.at, self.sent = op, now, now if op == "sent" else self.sent
        return op

    def step(self, now: float, op: str, sent_elsewhere: float | None = None, quota: int | None = None) -> str:
        return self.reserve(now, sent_elsewhere, quota) if op == "reserve" else self.finish(now, op)


#: A request, with what else is known of it: when the directory says that it was last sent to, and how many may be sent today; null: not known.
REQUEST = ["uid", "t", "pos", "op", "sent_elsewhere", "quota"]


def with_sent_elsewhere(log: DataFrame, directory: DataFrame) -> DataFrame:
    """ST-12: requests with the directory's last time of sending (uid, sent_at; the latest of a uid), from 0 to null where it has none."""
    last = directory.groupBy(F.col("uid").alias("__u")).agg(F.max("sent_at").cast("double").alias("sent_elsewhere"))
    rows = log.join(last, F.col("uid") == F.col("__u"), "left").drop("__u")
    return rows if "quota" in log.columns else rows.withColumn("quota", F.lit(None).cast("int"))


def send_reservations(log: DataFrame) -> DataFrame:
    """ST-12: (uid is owner and address, t, pos, op in reserve, sent, failed; sent_elsewhere, quota) -> (uid, pos, status)."""

    def start():
        lease = Lease()

        def one(row):
            known = [None if x is None or x != x else x for x in (row.sent_elsewhere, row.quota)]
            return {"uid": row.uid, "pos": row.pos, "status": lease.step(float(row.t), row.op, *known)}

        return one

    full = log.select(*[F.col(c) if c in log.columns else F.lit(None).cast("double").alias(c) for c in REQUEST])
    return replay(full, start, "uid string, pos long, status string")


#: Idle users' states are looked for so often.
PRUNE_EVERY_S = 6 * 3_600


def prune_budgets(states: DataFrame, now_s: int, last_s: int | None = None) -> DataFrame:
    """ST-14: stored budgets (uid, times: seconds, packed as by ``delta36``) without those of users who did not ask for a day. A text that can't be read stays, for it must not set a budget free. Nothing goes within six hours of the last time (``last_s``)."""
    if last_s is not None and now_s - last_s < PRUNE_EVERY_S:
        return states
    readable = F.coalesce(F.col("times").rlike(r"^(-?[0-9a-z]+(\.-?[0-9a-z]+)*)?$"), F.lit(False))
    last = F.array_max(X.undelta36(F.when(readable, F.col("times")).otherwise("")))
    return states.where(~readable | (F.lit(now_s) - last < DAY_S))


def window_counts(log: DataFrame) -> DataFrame:
    """W-06: requests of a user in the ten minutes and the day up to each, whatever was decided."""
    by = W.partitionBy("uid").orderBy("t")
    return log.select("uid", "t", "pos", F.count("*").over(by.rangeBetween(-SHORT_S + 1, 0)).alias("short"), F.count("*").over(by.rangeBetween(-DAY_S + 1, 0)).alias("day"))


def over_limit(rows: DataFrame, admins: DataFrame, limit: int = 20) -> DataFrame:
    """ST-13: owners with as many distinct addresses as the limit or more; admins are exempt."""
    n = rows.where("status <> 'revoked'").groupBy("owner_uid").agg(F.count_distinct("invitee_email").alias("n"))
    return n.join(admins.where("active").select(F.col("uid").alias("owner_uid")), "owner_uid", "left_anti").where(F.col("n") >= limit)
