"""Stream queries: the same figures as in batch, from a stream over the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ledger as L
from .registry import Tables, query


@query("stream_usage_windows", "S18 S42 A17", "select strftime(ts, '%Y-%m-%d 00:00') as begin, event_type, count(*) as calls, round(sum(value), 2) as total from events group by all")
def stream_usage_windows(t: Tables) -> DataFrame:
    """Each batch gives the windows it has changed; the last state of a window counts."""
    return L.run_once(L.windowed_usage(L.events_stream(t.spark, t.folder)), "update", (["begin", "event_type"], "calls"))


@query("stream_streaks", "S18", """
with m as (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as best from events),
g as (select *, sum(case when best is null or value > best then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from m),
c as (select user_id, grp, count(*) - 1 as n from g group by all)
select user_id, arg_max(n, grp) as now, max(n) as longest from c group by user_id""")
def stream_streaks(t: Tables) -> DataFrame:
    """The table is there at once, so nothing is later than what its own watermark allows."""
    return L.run_once(L.streaks(L.events_stream(t.spark, t.folder), late="0 seconds"), "update", (["user_id"], "upto")).drop("upto")


@query("stream_asof_search", "J17 S14", """
with c as (select user_id, event_id, ts, event_type from events where event_type in ('click', 'view')),
s as (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_search from c)
select user_id, event_id, last_search from s where event_type = 'click'""")
def stream_asof_search(t: Tables) -> DataFrame:
    """The latest view before each click, from a stream."""
    events = L.events_stream(t.spark, t.folder).filter("event_type in ('click', 'view')")
    return L.run_once(L.as_of_stream(events, "user_id", F.col("event_type") == "view", late="0 seconds", idle="10000 days"))


@query("session_windows", "W11", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as begin, count(*) as events from s group by user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    return L.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
