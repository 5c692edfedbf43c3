"""What the corpus operators share: the shared scratch folder, staging and graph components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear_stored, discard, fresh, shared_dir, shared_path, stored  # noqa: F401  shared by the operators

#: The white space of the text contracts: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a written table. A checkpoint would hand on the constraints that the optimizer has
    inferred, which multiply from round to round of an iteration; a table's files hold rows alone."""
    return stored(df, "step")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """What runs meanwhile hands its tasks' Python about `size` bytes at a time instead of 64 MB, which the JVM and the
    worker of each core hold at once, the former twice while a buffer grows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """The component of every node of edges(u, v): rows (node, component), component being its smallest node.

    Alternates large-star and small-star contraction until the edges are stars: no node is at both ends, none has two
    edges. In each round the smallest neighbours, an aggregation that combines map-side, are written before they are
    joined: so the join is of two plain exchanges, which adaptive execution splits where a hub has many neighbours. The
    rounds grow with the logarithm of the largest component's size; `max_rounds` is far beyond what any table needs and
    guards against an endless job.
    """

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("n")))
        seen = ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("low"))
        return seen.filter("n > 1 OR (n = 1 AND low = 0)").isEmpty()

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
        low = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")))
        moved = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    now = checkpointed(small(checkpointed(edges)))
    for _ in range(max_rounds):
        if stars(now):
            roots = now.select(F.col("v").alias("u"), "v").distinct()
            return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = checkpointed(small(checkpointed(large(now))))
    raise RuntimeError("components did not settle")
