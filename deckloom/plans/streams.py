"""Queries of the stream operators over the static events table."""

from __future__ import annotations

from deckloom.sources.tables import table
from deckloom.streaming import events as E

QUERIES = {
    "rate_limited": lambda spark, sf_dir: E.rate_limited(table(spark, sf_dir, "events")),
    "circuit_breaker": lambda spark, sf_dir: E.breaker(table(spark, sf_dir, "events")),
    "paced_calls": lambda spark, sf_dir: E.paced(table(spark, sf_dir, "events")),
    "view_counts": lambda spark, sf_dir: E.view_counts(table(spark, sf_dir, "events")),
}

ORACLE = {
    "view_counts": "SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY user_id",
    "paced_calls": """WITH r AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
g AS (SELECT user_id, count(*) AS n, max(t) AS last, max(t - k * 4.2::DOUBLE) AS ahead FROM r GROUP BY user_id) SELECT user_id, n, round_even(ahead + (n - 1) * 4.2::DOUBLE - last, 3) AS delay FROM g""",
}
