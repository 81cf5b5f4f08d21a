"""The usage ledger as a stream: files are tailed through a checkpoint, late events are bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import settled
from ..operators.ranking import keep_best
from ..sources.folders import exists, new_path, removed

LEDGER = "ts timestamp, model string, purpose string, prompt_tokens int, completion_tokens int, total_tokens int, latency_s double, stream boolean, ok boolean, error string"


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of daily files; lines that can't be read are dropped, new lines of rolled files are picked up by the checkpoint."""
    return spark.readStream.schema(LEDGER).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.{jsonl,json}").json(folder)


def ledger_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same files at once."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.{jsonl,json}").json(folder).filter("ts is not null")


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files, its time zone-less stamps as timestamps."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, kind: str = "event_type", value: str = "value", length: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Calls and sums by window and kind. The watermark lets finished windows leave the state."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    got = w.groupBy(F.window("ts", length).alias("w"), kind).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("begin"), kind, "calls", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, user: str = "user_id", gap: str = "6 hours") -> DataFrame:
    """Sessions by inactivity, in batch or stream."""
    w = events.withWatermark("ts", gap) if events.isStreaming else events
    got = w.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("events"))
    return got.select(user, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "events")


def streaks(events: DataFrame, user: str = "user_id", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Stateful: how many events in a row brought no new maximum for the user, and the longest such run, in order of time.

    Events wait in state until the watermark has passed them, and are then taken in order of (ts, event_id), so neither the order of
    arrival nor the size of batches matters as long as no event is later than `late`. A row comes for each user and batch that settles
    events, `upto` being the last of them; what has been settled leaves the state."""
    state = _state(best=T.DoubleType(), now=T.LongType(), longest=T.LongType(), at=T.ArrayType(T.LongType()), ids=T.ArrayType(T.LongType()), values=T.ArrayType(T.DoubleType()))

    def step(key, frames, held):
        import pandas as pd

        best, now, longest, *waiting = held.get if held.exists else (float("-inf"), 0, 0, [], [], [])
        ready, rest = _settled_rows(frames, held, waiting, ["at", "event_id", "value"])
        for _, _, v in ready:
            best, now = (v, 0) if v > best else (best, now + 1)
            longest = max(longest, now)
        held.update((float(best), int(now), int(longest), *_columns(rest, (int, int, float))))
        if rest:
            _wake(held, rest[0][0])
        if ready:
            yield pd.DataFrame({user: [key[0]], "upto": [int(ready[-1][0])], "now": [now], "longest": [longest]})

    marked = _marked(events, late, user, F.col(value).cast("double").alias("value"))
    got = marked.groupBy(user).applyInPandasWithState(step, f"{user} long, upto long, now long, longest long", state, "update", "EventTimeTimeout")
    return got.withColumn("upto", F.timestamp_micros("upto"))


def _state(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _marked(events: DataFrame, late: str, *columns: Column | str) -> DataFrame:
    """Time as microseconds beside the stamp that the watermark follows: the time zone plays no part."""
    return events.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("at"), "event_id", *columns)


def _settled_rows(frames, held, waiting: list, names: list[str]) -> tuple[list[tuple], list[tuple]]:
    """What waited and what has come, in order of time: the rows that the watermark has passed, and the others."""
    rows = list(zip(*waiting, strict=True))
    if not held.hasTimedOut:
        for part in frames:
            rows += part[names].itertuples(index=False, name=None)
    rows.sort(key=lambda r: (r[0], r[1]))
    mark = held.getCurrentWatermarkMs() * 1000 + 999
    return [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]


def _columns(rows: list[tuple], kinds: tuple) -> list[list]:
    return [[kind(r[i]) for r in rows] for i, kind in enumerate(kinds)]


def _wake(held, at: int) -> None:
    """Have the group called once the watermark reaches this microsecond."""
    held.setTimeoutTimestamp(max(int(at) // 1000 - 1, held.getCurrentWatermarkMs() + 1))


def as_of_stream(events: DataFrame, group: str, searched: Column, late: str = "1 hour", idle: str = "6 hours") -> DataFrame:
    """(group, event_id, last_search): each call with the latest search of its group before it, in order of (ts, event_id).

    Events wait until the watermark has passed them; of what is settled only the group's latest search stays in state, and a group
    that is idle for longer than `idle` leaves it altogether (its next call has no search)."""
    patience = _seconds(idle) * 1_000_000
    state = _state(last=T.LongType(), seen=T.LongType(), at=T.ArrayType(T.LongType()), ids=T.ArrayType(T.LongType()), searches=T.ArrayType(T.BooleanType()))

    def step(key, frames, held):
        import pandas as pd

        last, seen, *waiting = held.get if held.exists else (None, 0, [], [], [])
        ready, rest = _settled_rows(frames, held, waiting, ["at", "event_id", "search"])
        out = []
        for at, i, is_search in ready:
            if seen and at - seen > patience:
                last = None
            seen = int(at)
            if is_search:
                last = int(i)
            else:
                out.append((key[0], int(i), last))
        if not rest and held.getCurrentWatermarkMs() * 1000 - seen > patience:
            held.remove()
        else:
            held.update((last, seen, *_columns(rest, (int, int, bool))))
            _wake(held, rest[0][0] if rest else seen + patience + 2000)
        if out:
            yield pd.DataFrame({group: [x[0] for x in out], "event_id": [x[1] for x in out], "last_search": pd.array([x[2] for x in out], "Int64")})

    marked = _marked(events, late, group, searched.alias("search"))
    return marked.groupBy(group).applyInPandasWithState(step, f"{group} long, event_id long, last_search long", state, "append", "EventTimeTimeout")


def _seconds(length: str) -> int:
    n, unit = length.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def run_once(stream: DataFrame, mode: str = "append", newest: tuple[list[str], str] | None = None) -> DataFrame:
    """Drive a stream over what is there now, into Parquet in the shared folder: each micro-batch writes its rows under its number, so
    a batch that is repeated after a failure replaces its own. With `newest` (keys, order) the last row of each key counts."""
    spark = stream.sparkSession
    path, mark = new_path(spark, "stream"), new_path(spark, "mark")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", mark).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    removed(spark, mark)
    if not exists(spark, path):
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if newest:
        keys, order = newest
        out = keep_best(out, keys, [F.desc(order), F.desc("batch")])
    out = settled(out.drop("batch"))
    removed(spark, path)
    return out


def append_new(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what has come since the checkpoint to a Parquet table, exactly once, and return the table."""
    to = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    to.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
