"""Event queries: the batch forms of the streaming windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.storage import read_table
from lodegraph.streaming import events as E

QUERIES = {
    "s_tumbling": lambda s, d: E.tumbling_counts(read_table(s, d, "events"), watermark=None).select("window_start", "event_type", "n", F.round("total", 4).alias("total")),
    "s_sliding": lambda s, d: E.sliding_counts(read_table(s, d, "events"), watermark=None),
    "s_sessions": lambda s, d: E.user_sessions(read_table(s, d, "events"), watermark=None),
}

ORACLES = {
    "s_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "s_sliding": "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL",
    "s_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k""",
}
