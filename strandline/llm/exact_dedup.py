"""Exact deduplication through an extendible-hash index on shared files.

Texts are equal when identical after deleting the space and U+0009..U+000D. The index maps the 64-bit hash of the
normalised text to a chain of entries, one for each different text with that hash:

1. one scan writes a ledger of ids and hashes; the directory starts with one bucket and doubles while a bucket holds
   more different hashes than `capacity`: overfull buckets split by the next bit of the hash;
2. the documents, texts and all, go to owner tasks. An owner has a range of the directory's slots, so every bucket
   lies with one owner. Copies of a hash that holds more than a 1/1024 of all rows are first combined by bytes where
   they are read and then over a few salts: so few hashes can be so common that their list has a fixed size;
3. an owner chains the different texts of a hash, comparing their bytes, chooses of each the document that stays and
   writes its buckets as files in the shared folder;
4. every document looks itself up by owner and hash. Where a hash has one entry, all its documents have been compared
   with that entry at the owner; where it has a chain, they are compared with its texts, byte by byte.

Everything runs as DataFrame operations. A text crosses the network once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, fresh, stored

#: A hash is common when it holds more than one of so many rows: at most so many hashes can.
_SHARE = 1024
_SALTS = 16


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.xxhash64("norm")
    if hash_bits < 64:  # for tests: collisions
        h = h.bitwiseAND(F.lit(-1 << (64 - hash_bits)))
    return docs.select(F.col(id_col).alias("id"), F.translate(raw, SPACES, "").alias("norm"), F.length(raw).alias("points")).withColumn("h", h)


def _prefix(h: Column, depth: Column | int) -> Column:
    """The first `depth` bits of a hash; none is 0."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")
    return F.expr(f"IF({depth._jc.toString()} = 0, 0L, shiftrightunsigned({h._jc.toString()}, 64 - {depth._jc.toString()}))")


def build_directory(hashes: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, int]:
    """Buckets (depth, prefix, n) over the different hashes(h), and the global depth.

    A table of counts by the first `max_depth` bits is made once; the rounds of doubling read that table. A bucket
    that still exceeds `capacity` at `max_depth` stays as it is.
    """
    counts = checkpointed(hashes.groupBy(_prefix(F.col("h"), max_depth).alias("p")).agg(F.count("*").alias("n")))
    depth = 0
    buckets = checkpointed(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "n"))
    while depth < max_depth:
        over = buckets.filter((F.col("depth") == depth) & (F.col("n") > capacity))
        if over.isEmpty():
            break
        depth += 1
        halves = (
            counts.select("n", F.shiftright("p", max_depth - depth).alias("prefix"))
            .groupBy("prefix")
            .agg(F.sum("n").alias("n"))
            .join(over.select(F.col("prefix").alias("parent")), F.shiftright("prefix", 1) == F.col("parent"), "left_semi")
            .select(F.lit(depth).alias("depth"), "prefix", "n")
        )
        buckets = checkpointed(buckets.filter((F.col("depth") < depth - 1) | (F.col("n") <= capacity)).unionByName(halves))
    return buckets, depth


_BEST = "min(struct(-points AS points, id IS NULL AS none, id))"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, max_depth: int = 24, hash_bits: int = 64, task_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """The ledger (owner, h, id) of docs and their index: owner, depth, bucket (the first hash prefix of the bucket),
    h, chain (place among entries with the same hash, from 0), chained (entries with that hash), sha, keep_id,
    group_size, and norm, the text itself, where there is more than one entry. The tasks of
    the owners are as many as shuffle partitions, and more where one would get more than `task_bytes` of texts."""
    keyed = _keyed(docs, id_col, text_col, hash_bits)
    ledger = stored(keyed.select("id", "h", F.octet_length("norm").cast("long").alias("size")), "ledger")
    held = checkpointed(ledger.groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    rows, size = (x or 0 for x in held.agg(F.sum("n"), F.sum("size")).first())
    common = F.broadcast(checkpointed(held.filter(F.col("n") > max(rows / _SHARE, 16)).select("h")))  # fewer than _SHARE
    buckets, depth = build_directory(held.select("h"), capacity, max_depth)
    shallow = buckets.agg(F.min("depth")).first()[0]
    # No bucket is split between owners: they are at most as many as the shallowest bucket's depth gives.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / task_bytes))
    bits = min(shallow, math.ceil(math.log2(16 * parts)))
    few = keyed.join(common, "h", "left_semi").groupBy(F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt"), "h", "norm").agg(F.count("*").alias("n"), F.expr(_BEST).alias("best"))
    rest = keyed.join(common, "h", "left_anti").select("h", "norm", F.lit(1).cast("long").alias("n"), F.expr("struct(-points AS points, id IS NULL AS none, id) AS best"))
    sent = few.select("h", "norm", "n", "best").unionByName(rest).withColumn("owner", _prefix(F.col("h"), bits)).repartition(parts, "owner")
    entries = sent.groupBy("owner", "h", "norm").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))  # the bytes are compared here
    chain = Window.partitionBy("owner", "h")
    chained = entries.withColumn("chained", F.count("*").over(chain)).withColumn("chain", F.row_number().over(chain.orderBy("norm")) - 1)
    text = F.when(F.col("chained") > 1, F.col("norm")).alias("norm")
    written = stored(chained.select("owner", "h", "chain", "chained", F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("keep_id"), "group_size", text), "entries")
    # An entry's bucket is the deepest prefix of its hash that the directory holds: one probe for each depth in use.
    probes = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("h"), d).alias("prefix")) for d in range(shallow, depth + 1)])
    index = written.withColumn("p", F.explode(probes)).select("*", "p.depth", "p.prefix").join(buckets.drop("n"), ["depth", "prefix"])
    index = index.withColumn("bucket", F.expr("IF(depth = 0, 0L, shiftleft(prefix, 64 - depth))")).drop("p", "prefix")
    return ledger.select("id", "h", _prefix(F.col("h"), bits).alias("owner")), index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, max_depth: int = 24, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest id (a null id
    comes last). Null text counts as empty; all empty texts are equal. Rows that repeat an id are one document and
    carry the same verdict. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    ledger, index = build_index(docs, id_col, text_col, capacity, max_depth, hash_bits)
    return _verdicts(docs, ledger, index, id_col, text_col, hash_bits)


def _verdicts(docs: DataFrame, ledger: DataFrame, index: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    said = ("keep_id", "group_size", F.col("sha").alias("text_sha256"))
    found = ledger.join(index.filter("chained = 1").select("owner", "h", *said), ["owner", "h"]).select("id", "keep_id", "group_size", "text_sha256")
    chains = checkpointed(index.filter("chained > 1").select("h", "norm", *said))
    if not chains.isEmpty():
        crowded = chains.select("h").distinct()
        some = _keyed(docs, id_col, text_col, hash_bits).join(crowded, "h", "left_semi")
        found = found.unionByName(some.join(chains, ["h", "norm"]).select("id", "keep_id", "group_size", "text_sha256"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns, whatever their names. A row is known by its id and
    its text's digest, so rows that share an id but not a text are judged each; exact repeats of one row stay
    together. Null and empty texts are one group, a null id is kept only where its group has no other. An empty table
    gives no rows."""
    verdicts = exact_dedup(docs, id_col, text_col).filter("kept").select(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).alias("k")).distinct()
    own = fresh("key", docs.columns)
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACES, ""), 256)
    named = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), digest.alias("sha")))
    return named.join(verdicts.withColumnRenamed("k", fresh("k", named.columns)), F.expr(f"`{own}` <=> `{fresh('k', named.columns)}`"), "left_semi").drop(own)
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
