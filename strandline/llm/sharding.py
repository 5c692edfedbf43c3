"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniformly random arrangement the number of rows that go from each input partition to each shard follows a
multivariate hypergeometric law, given the partitions' and the shards' sizes. So these counts are drawn first, and
then only the rows that fill them:

1. one pass keeps the rows with their partition and a random order within it (the first local permutation);
2. the matrix is drawn: first for groups of partitions, then, in tasks, for the partitions of each group;
3. a partition's first rows in its random order go to shard 0, as many as the matrix says, the next to shard 1, ...;
4. within a shard rows are permuted again: a second random number deals them to cells of bounded size and orders them
   in their cell, and a slot is the place in the cell plus the rows of the cells before.

Random numbers are hashes of the seed and a row's stored place, so a repeated task draws the same ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Partitions of which one task draws the rows of the matrix.
_GROUP = 1024
_PLACE = (1 << 33) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from good + bad items without replacement are good, for counts up to 2^53.

    By inversion over the probabilities within 12 standard deviations of the mode, from their exact ratios; what lies
    beyond has less than 1e-30 of the mass. numpy's own generator ends at 1e9 items.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(total - 1, 1))
    reach = 50 + math.ceil(12 * spread)
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)  # the log ratio of the probabilities of k + 1 and k
    log = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))])
    p = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def matrix_rows(rng: np.random.Generator, sizes: list[int], budget: list[int]) -> np.ndarray:
    """A row for each of `sizes`: how many of its items go to each shard, the columns summing up to `budget`."""
    left, out = list(budget), np.zeros((len(sizes), len(budget)), np.int64)
    for i, n in enumerate(sizes):
        rest = sum(left)
        for s in range(len(left)):
            take = hypergeometric(rng, left[s], rest - left[s], n)
            rest -= left[s]
            left[s] -= take
            n -= take
            out[i, s] = take
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, bounds): for each partition of counts(part, n) the running sums, from 0, of its rows to each shard."""
    spark = counts.sparkSession
    groups = counts.groupBy(F.floor(F.col("part") / _GROUP).alias("bundle")).agg(F.sum("n").alias("n")).orderBy("bundle").collect()  # one row for 1,024 partitions
    budgets = matrix_rows(np.random.default_rng([seed, 0]), [r.n for r in groups], shard_sizes(sum(r.n for r in groups), shards)).tolist()
    shares = spark.createDataFrame([(r.bundle, b) for r, b in zip(groups, budgets)], "bundle long, budget array<long>")

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        rows = matrix_rows(np.random.default_rng([seed, 1, int(key[0])]), pdf["n"].tolist(), list(pdf["budget"].iloc[0]))
        bounds = np.concatenate([np.zeros((len(rows), 1), np.int64), rows.cumsum(axis=1)], axis=1)
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "bounds": list(bounds)})

    named = counts.withColumn("bundle", F.floor(F.col("part") / _GROUP)).join(shares, "bundle")
    return named.groupBy("bundle").applyInPandas(draw, "part long, bounds array<long>")


def uniform_shards(rows: DataFrame, shards: int = 8, seed: int = 0, cell_rows: int = 1 << 16) -> DataFrame:
    """rows with a shard and a slot, gapless from 0 in each shard: a uniformly random arrangement in shards whose counts
    are at most one apart.

    Every row is placed for itself, whatever it holds: nulls, repeated and empty rows alike. Where rows has columns of
    these names, the new ones begin with underscores. The same partitions and seed give the same arrangement. An
    empty table gives no rows. A task of the last step holds about `cell_rows` rows of one shard.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    shard, slot = fresh("shard", rows.columns), fresh("slot", rows.columns)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    dealt = rows.select(F.struct("*").alias("row"), F.spark_partition_id().cast("long").alias("part"), place.alias("place"))
    mixed = dealt.sortWithinPartitions(F.xxhash64(F.lit(seed), F.lit(1), "part", "place"), "place").drop("place")
    ledger = stored(mixed.withColumn("rank", place), "ledger")
    counts = stored(ledger.groupBy("part").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    matrix = stored(communication_matrix(counts, shards, seed), "matrix")
    bits = max(0, math.ceil(math.log2(max(total / (shards * cell_rows), 1))))
    key = F.xxhash64(F.lit(seed), F.lit(2), "part", "rank")
    cell = F.shiftrightunsigned(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long")
    sent = ledger.join(matrix, "part").withColumn("shard", F.expr("size(filter(bounds, b -> b <= rank)) - 1")).withColumn("key", key)
    sent = sent.select("row", "part", "rank", "key", "shard", cell.alias("cell"))
    cells = stored(sent.groupBy("shard", "cell").agg(F.count("*").alias("n")), "cells")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("shard", "cell", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy(F.col("key").bitwiseXOR(F.lit(-1 << 63)), "part", "rank")  # as unsigned
    out = sent.join(starts, ["shard", "cell"])
    return out.select("row.*", F.col("shard").alias(shard), (F.col("before") + F.row_number().over(order) - 1).alias(slot))


def write_shards(rows: DataFrame, path: str, shards: int = 8, seed: int = 0, tasks: int | None = None) -> None:
    """The arrangement of `uniform_shards` as Parquet files, in a folder shard=.. for each shard. A file holds a range of
    slots in order; a shard has as many files as tasks reach into it."""
    out = uniform_shards(rows, shards, seed)
    shard, slot = out.columns[-2:]
    n = tasks or max(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = stored(out, "arranged")  # a range partitioning reads its input twice
    held.repartitionByRange(n, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def digest_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): the UTF-8 bytes of the text plus 1, null having none, and their CRC-32."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law of rows."""
    out = uniform_shards(digest_columns(docs), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
