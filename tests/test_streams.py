"""Streams in many micro-batches, out of order, against the same figures in batch."""

import random

from pyspark.sql import functions as F

from lexquarry.operators import ordered as O
from lexquarry.streaming import ledger as L

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def written(spark, path, hours=30, users=7):
    """Files whose rows are shuffled over six hours, and a last one from long after that lets all before it settle."""
    rng, rows = random.Random(7), []
    for i in range(900):
        at = rng.randrange(hours * 3600)
        rows.append((i, at, rng.randrange(users), rng.choice(["click", "view", "other"]), float(rng.randrange(50))))
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(6 * 3600))
    begin = 1_700_000_000
    frame = lambda part: spark.createDataFrame([(i, t + begin, u, e, v) for i, t, u, e, v in part], "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value")
    for n in range(0, 900, 150):
        frame(order[n : n + 150]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    batch = frame(rows)
    frame([(10_000, 400 * 3600, -1, "click", 0.0)]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return batch


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_streaks_follow_time_not_arrival(spark, tmp_path, monkeypatch):
    batch = written(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = L.run_once(L.streaks(stream(spark, str(tmp_path)), late="6 hours"), "update", (["user_id"], "upto")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for r in sorted(batch.collect(), key=lambda r: (r["ts"], r["event_id"])):
        best, now, longest = want.get(r["user_id"], (-1.0, 0, 0))
        best, now = (r["value"], 0) if r["value"] > best else (best, now + 1)
        want[r["user_id"]] = (best, now, max(longest, now))
    assert {r["user_id"]: (r["now"], r["longest"]) for r in got if r["user_id"] >= 0} == {u: x[1:] for u, x in want.items()}


def test_as_of_over_shuffled_batches(spark, tmp_path):
    batch = written(spark, str(tmp_path)).filter("event_type in ('click', 'view')")
    events = stream(spark, str(tmp_path)).filter("event_type in ('click', 'view')")
    got = L.run_once(L.as_of_stream(events, "user_id", F.col("event_type") == "view", late="6 hours", idle="1000 hours")).filter("user_id >= 0")
    s = O.carried(batch, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "view", F.col("event_id")), "last_search").filter("event_type = 'click'").select("user_id", "event_id", "last_search")
    assert sorted(map(str, got.collect())) == sorted(map(str, s.collect()))


def test_idle_groups_leave_the_state(spark, tmp_path):
    """After the last event, long after all others, no group but its own is in state."""
    written(spark, str(tmp_path))
    q = L.as_of_stream(stream(spark, str(tmp_path)), "user_id", F.col("event_type") == "view", late="6 hours", idle="10 hours").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 7 and rows[-1] <= 1
