import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import limits
from shelfspark.streaming import budget, leases, notifications

REQUESTS = "uid string, t double, pos long, addresses array<string>"
LOG = "uid string, t double, pos long, op string, sent_elsewhere double, quota double"


class Feed:
    """A stream of batches, one at a time, into a table in memory."""

    def __init__(self, spark, path, schema, make):
        self.spark, self.schema, self.at, self.n = spark, schema, str(path / "in"), 0
        spark.createDataFrame([], schema).write.parquet(self.at)
        self.name = f"t{random.randrange(1 << 40)}"
        df = make(spark.readStream.schema(schema).parquet(self.at))
        self.checkpoint = str(path / "c")
        self.query = df.writeStream.format("memory").queryName(self.name).outputMode("append").option("checkpointLocation", self.checkpoint).start()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.at)
        self.query.processAllAvailable()

    def rows(self):
        return self.spark.table(self.name)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_budget_decides_as_the_batch_does_and_forgets_idle_users(spark, tmp_path):
    r = random.Random(7)
    log, t = [], 0.0
    for pos in range(400):
        t += r.choice([1.0, 20.0, 400.0])
        log.append((r.choice(["u", "v"]), t, pos, [f"a{r.randint(0, 40)}" for _ in range(r.randint(0, 5))] or None))
    feed = Feed(spark, tmp_path, REQUESTS, budget.stream_budget)
    for i in range(0, 400, 100):
        feed.put(r.sample(log[i : i + 100], 100))
    want = {(x.uid, x.pos): (x.accepted, x.charged) for x in limits.lookup_budget(spark.createDataFrame(log, REQUESTS)).collect()}
    assert {(x.uid, x.pos): (x.accepted, x.charged) for x in feed.rows().collect()} == want and {a for a, _ in want.values()} == {True, False}

    def users():
        times = spark.read.format("statestore").option("stateVarName", "times").load(feed.checkpoint)
        return {x.uid for x in times.select("key.uid").distinct().collect()}

    assert users() == {"u", "v"}
    # the clock of the requests, ten minutes late, moves on: u stays busy, v comes to a day after what was last charged
    end = max(t for uid, t, pos, _ in log if uid == "v" and want[uid, pos][1]) + limits.DAY_S + 600
    feed.put([("u", end - 100, 1000, ["z1"])])
    feed.put([("u", end - 99, 1001, ["z1"])])
    assert users() == {"u", "v"}
    feed.put([("u", end + 100, 1002, ["z1"])])
    feed.put([("u", end + 101, 1003, ["z1"])])
    assert users() == {"u"}
    feed.query.stop()


def test_leases_decide_as_the_batch_does_and_run_out(spark, tmp_path):
    batches = [
        [("k", 0.0, 0, "reserve", None, None), ("k", 10.0, 1, "reserve", None, None), ("w", 5.0, 2, "reserve", None, 0.0), ("d", 50.0, 3, "reserve", 20.0, None)],
        [("k", 700.0, 4, "reserve", None, None), ("k", 710.0, 5, "sent", None, None), ("w", 720.0, 6, "reserve", None, 5.0), ("w", 730.0, 7, "failed", None, None)],
        [("k", 900.0, 8, "reserve", None, None), ("w", 910.0, 9, "reserve", None, None), ("d", 3700.0, 10, "reserve", 20.0, None)],
        [("k", 5000.0, 11, "reserve", None, None), ("k", 5001.0, 12, "failed", None, None), ("k", 5002.0, 13, "reserve", None, None)],
    ]
    # the clock of a stream begins at 0, and what is not after it is late
    batches = [[(uid, t + 1e6, pos, op, sent and sent + 1e6, quota) for uid, t, pos, op, sent, quota in b] for b in batches]
    feed = Feed(spark, tmp_path, LOG, leases.stream_reservations)
    for b in batches:
        feed.put(b)
    got = {x.pos: x.status for x in feed.rows().where("pos is not null").collect()}
    assert got == {0: "reserved", 1: "sending", 2: "quota", 3: "cooldown", 4: "reserved", 5: "sent", 6: "reserved", 7: "failed", 8: "cooldown", 9: "reserved", 10: "reserved", 11: "reserved", 12: "failed", 13: "reserved"}
    assert got == {x.pos: x.status for x in limits.send_reservations(spark.createDataFrame([x for b in batches for x in b], LOG)).collect()}
    # nobody finishes what was reserved: the leases of d, w and k run out
    feed.put([("other", 1e6 + 20_000, 99, "failed", None, None)])
    feed.put([("other", 1e6 + 20_001, 100, "failed", None, None)])
    feed.query.stop()
    assert {x.uid for x in feed.rows().where(F.col("status") == leases.EXPIRED).collect()} == {"d", "w", "k"}


CHANGES = "viewer string, owner_uid string, active boolean, at long"


def events(spark, path):
    return sorted((r.viewer, r.owner_uid, r["event"], r["at"]) for r in notifications.notification_events(spark, path).collect())


def loop(batches):
    on, out = {}, []
    for b in batches:
        for viewer, owner, active, at in sorted(b, key=lambda r: (r[3], r[2])):
            if active != on.get((viewer, owner), False):
                out.append((viewer, owner, "new" if active else "dropped", at))
            on[viewer, owner] = active
    return sorted(out)


def test_notifications_of_a_replayed_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(notifications, "TOGETHER", 2)
    r, path = random.Random(3), str(tmp_path / "n")
    batches = [[(r.choice("vw"), r.choice("opq"), r.random() < 0.5, 100 * n + i) for i in range(12)] for n in range(6)]
    for n, b in enumerate(batches):
        notifications.apply_batch(spark.createDataFrame(b, CHANGES), n, path)
        if n in (1, 3, 4):  # it comes again, whole
            before = events(spark, path)
            notifications.apply_batch(spark.createDataFrame(r.sample(b, 12), CHANGES), n, path)
            assert events(spark, path) == before
    assert events(spark, path) == loop(batches)


def test_notifications_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "n")
    spark.createDataFrame([], CHANGES).write.parquet(src)
    q = notifications.stream_notifications(spark.readStream.schema(CHANGES).parquet(src), path, str(tmp_path / "c"))
    batches = [[("v", "o", True, 1), ("v", "o", True, 2), ("v", "o", False, 3), ("v", "o", True, 4)], [("v", "o", True, 5), ("w", "o", True, 6)]]
    for b in batches:
        spark.createDataFrame(b, CHANGES).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    q.stop()
    assert events(spark, path) == loop(batches)


def test_windowed_lookups_drop_what_is_late(spark, tmp_path):
    schema = "uid string, t double"
    feed = Feed(spark, tmp_path, schema, lambda s: notifications.windowed_lookups(s.select("uid", F.timestamp_seconds("t").alias("ts"))).select("uid", F.unix_seconds("window.start").alias("start"), "n"))
    feed.put([("u", 10.0), ("u", 20.0), ("u", 400.0)])
    feed.put([("u", 5000.0)])
    feed.put([("u", 30.0), ("u", 9000.0)])
    feed.put([("u", 9001.0)])
    feed.query.stop()
    assert {(x.start, x.n) for x in feed.rows().where("start < 1000").collect()} == {(-300, 2), (0, 3), (300, 1)}
