"""Change streams and event-time windows over the same rows as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...streaming import changes, views
from .base import Tables, query

c = F.col
_LATEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events"


@query(f"""WITH last AS (SELECT user_id, event_type, value FROM ({_LATEST}) WHERE n = 1)
SELECT user_id AS id, event_type AS kind, value FROM last WHERE event_type <> 'click'
UNION ALL SELECT DISTINCT -user_id, 'old', 0.0 FROM events WHERE -user_id NOT IN (SELECT user_id FROM events)""")
def change_apply_latest(t: Tables):
    return _applied(t.events.select(c("user_id").alias("id")).union(t.events.select(-c("user_id"))), t.events)


_LAST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events"


@query(f"""WITH last AS (SELECT user_id, event_type, value FROM ({_LAST}) WHERE n = 1),
base AS (SELECT user_id AS id FROM events UNION SELECT -user_id FROM events)
SELECT user_id AS id, event_type AS kind, value FROM last WHERE event_type <> 'click'
UNION ALL SELECT id, 'old', 0.0 FROM base WHERE id NOT IN (SELECT user_id FROM events)""")
def change_apply_latest_all(t: Tables):
    """All events, on rows that they replace or delete and, under negated ids, rows that none of them names."""
    return _applied(t.events.select(c("user_id").alias("id")).union(t.events.select(-c("user_id"))), t.events)


def _applied(ids, events):
    table = ids.select("id", F.lit("old").alias("kind"), F.lit(0.0).alias("value")).distinct()
    stream = events.select(c("event_id").alias("seq"), F.when(c("event_type") == "click", "deleted").otherwise("updated").alias("op"), c("user_id").alias("id"), c("event_type").alias("kind"), "value")
    return changes.applied(table, stream)


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY event_type")
def live_group_count(t: Tables):
    return views.live_groups(t.events, ["event_type"], n=F.count("*"), s=F.round(F.sum("value"), 2))


@query("SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY n")
def derived_chain(t: Tables):
    return views.live_groups(views.live_groups(t.events, ["user_id"], n=F.count("*")), ["n"], users=F.count("*"))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables):
    return views.tumbling(t.events, "ts", "6 hours", "event_type", n=F.count("*")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(t: Tables):
    return views.sessions(t.events, "ts", "12 hours", "user_id", n=F.count("*")).select("user_id", F.unix_micros(c("session_start").cast("timestamp")).alias("started"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_events(t: Tables):
    return views.once(t.events, ["user_id", "event_type"], "ts", "1 day").select("user_id", "event_type")
