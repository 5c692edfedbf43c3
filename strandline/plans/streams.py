"""Event queries that also run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming.rollup import windowed_rollup
from .base import query, r


@query(f"SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, {r('sum(value)', 'total', 4)}, count(*) - count(value) AS missing FROM events GROUP BY 1, 2", digits=4)
def event_windows(spark, sf):
    """Tumbling daily windows by event type."""
    w = windowed_rollup(table(spark, sf, "events"), "ts", "event_type", "value")
    return w.select(F.to_date("start").alias("day"), "event_type", "n", "total", "missing")
