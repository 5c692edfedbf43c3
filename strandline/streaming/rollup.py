"""Streams: windowed event roll-ups with watermarks, and the causal mean as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rollup(events: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count, sum and nulls of each key in tumbling windows of a (streaming or batch) DataFrame; events later than the
    watermark are dropped from a stream, as its contract says."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    g = marked.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count_if(F.col(value).isNull()).alias("missing"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total", "missing")


def causal_mean(events: DataFrame, key: str, order: str, value: str, half_life: float) -> DataFrame:
    """(key, n, mean): the exponentially weighted mean of each key after every micro-batch, its state (n, mean) kept by
    the engine. Within a batch rows count in `order`; a null value leaves the state as it is."""
    a = 0.5 ** (1.0 / half_life)
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for x in rows[value].dropna():
            n, mean = n + 1, a * mean + (1 - a) * float(x)
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)
