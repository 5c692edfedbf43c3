"""Places and ranks of rows within keys of any size, by range partitions.

A window over a key sorts all its rows in one task. Here the rows are dealt by ranges of (key, order), so that a key
may fill any number of tasks; each task counts what it holds of each key, the counts before it are summed over the
tasks, of which there are as many as partitions, and a row's place is its place in the task plus that sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh, stored


def _named(order: list[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in order]


def placed(df: DataFrame, by: list[str], order: list[str | Column], place: str = "place", rows: str = "rows") -> DataFrame:
    """df with each row's place among the rows of its key `by`, from 0 in `order`, and the number of those rows.

    Null keys are one key. Rows equal in key and order are told apart by where they were stored, in any order. df is
    stored first, as a range partitioning reads it twice. An empty table gives no rows.
    """
    spark = df.sparkSession
    salt, at, task = (fresh(x, [*df.columns, place, rows]) for x in ("salt", "at", "task"))
    kept = stored(df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id())), "unplaced")
    keys = [*map(F.col, by), *_named(order), F.col(salt)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(salt)
    # The task's number is in the upper bits, the row's place in the task in the lower 33.
    here = stored(dealt.withColumn(at, F.monotonically_increasing_id()), "placed").withColumn(task, F.shiftright(at, 33))
    count, first = (fresh(x, [*df.columns, place, rows, at, task]) for x in ("count", "first"))
    held = stored(here.groupBy(*by, task).agg(F.count("*").alias(count), F.min(at).alias(first)), "held")
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(count).over(over.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = held.select(*[F.col(c).alias(f"{first}_{k}") for k, c in enumerate(by)], F.col(task).alias(count), (before - F.col(first)).alias(first), F.sum(count).over(over).alias(rows))
    same = F.col(task) == F.col(count)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"{first}_{k}"))
    return here.join(starts, same).select(*[F.col(c) for c in df.columns], (F.col(at) + F.col(first)).alias(place), F.col(rows))


def average_rank(df: DataFrame, value: str, key: list[str], name: str = "avg_rank") -> DataFrame:
    """Rank of `value` from 1 within `key`, ties sharing their average, for keys of any size: the ties of one value, which
    may lie in several tasks, are summed up first. Nulls rank first, as in a window."""
    place, rows, low, n = (fresh(x, [*df.columns, name]) for x in ("place", "rows", "low", "ties"))
    own = placed(df, key, [value], place, rows)
    ties = own.groupBy(*key, value).agg(F.min(place).alias(low), F.count("*").alias(n))
    names = {c: fresh(f"tie_{k}", [*df.columns, name]) for k, c in enumerate([*key, value])}
    same = F.lit(True)
    for c, x in names.items():
        same &= F.col(c).eqNullSafe(F.col(x))
    ties = ties.withColumnsRenamed(names)
    return own.join(ties, same).select(*[F.col(c) for c in df.columns], (F.col(low) + (F.col(n) + 1) / 2.0).alias(name))
