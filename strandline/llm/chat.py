"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each snapshot extending the one before. Every turn's hash covers its
role and text; the hash of a prefix is the running sum of its turns' hashes, each mixed with its place, so that it
comes from one window over small rows. A conversation whose whole is a proper prefix of another one's is an earlier
snapshot: an anti-join on (length, two independent 64-bit hashes) drops it, and of equal conversations the smallest
id stays. Before it is dropped, a conversation is compared turn by turn with the one that absorbs it. What remains
is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: The chat template: one part for each turn, joined in turn order.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(TURN_CLOSE))


def _mixed(salt: int) -> Column:
    """A turn's hash with its place, kept to 62 bits so that sums of many turns stay exact as decimals."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col("k"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))), 2).cast("decimal(20,0)")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, h1, h2): the hash of the first k turns of every conversation, k from 1.

    Turns count in order of (turn, role, text), nulls first; rows that repeat a turn number are turns in that order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("k"))
    mixed = numbered.select("conv_id", "k", _mixed(1).alias("m1"), _mixed(2).alias("m2"))
    running = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return mixed.select("conv_id", "k", F.sum("m1").over(running).cast("decimal(38,0)").alias("h1"), F.sum("m2").over(running).cast("decimal(38,0)").alias("h2"))


def absorbed(turns: DataFrame) -> DataFrame:
    """(conv_id, absorbed_by) of the conversations that are a proper prefix of, or equal to, another one.

    absorbed_by is the smallest id of the longer ones, or of the equal ones where there is no longer one.
    """
    prefixes = checkpointed(turn_prefixes(turns))
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("k", "h1", "h2")).alias("w")).select("conv_id", "w.k", "w.h1", "w.h2")
    key = ["k", "h1", "h2"]
    equal = whole.groupBy(*key).agg(F.min("conv_id").alias("first"))
    ends = whole.select("conv_id", F.col("k").alias("n"))
    # One row for each different proper prefix: common first turns combine map-side.
    longer = prefixes.join(ends, "conv_id").filter("k < n").groupBy(*key).agg(F.min("conv_id").alias("longer"))
    # The keys are written first, so that the join on them is of two plain exchanges, which a common key may split.
    keys = checkpointed(equal.join(longer, key, "left"))
    found = checkpointed(whole).join(keys, key)
    by = F.coalesce("longer", F.when(F.col("conv_id") > F.col("first"), F.col("first")))
    candidates = found.select("conv_id", "k", by.alias("absorbed_by")).filter("absorbed_by IS NOT NULL")
    # The exact check: every turn of a candidate against the same place of its witness.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", F.row_number().over(order).alias("p"), "role", "text")
    own = placed.join(candidates, "conv_id")
    other = placed.select(F.col("conv_id").alias("absorbed_by"), "p", F.col("role").alias("role2"), F.col("text").alias("text2"))
    same = own.join(other, ["absorbed_by", "p"]).filter(F.col("role").eqNullSafe(F.col("role2")) & F.col("text").eqNullSafe(F.col("text2")))
    return same.groupBy("conv_id", "absorbed_by", "k").agg(F.count("*").alias("n")).filter("n = k").select("conv_id", "absorbed_by")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): conv_id, n_turns, kept, absorbed_by, rendered.

    rendered is null for a conversation that is not kept. Null roles and texts render as empty but differ from empty
    ones when conversations are compared. Turns without a conversation id belong to none and give nothing. Other
    columns are ignored; an empty table gives no rows.
    """
    turns = turns.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    gone = checkpointed(absorbed(turns))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    maximal = turns.join(gone, "conv_id", "left_anti")
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 31))).alias("turn"), "role", "text")))
    rendered = maximal.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: render_turn(x["role"], x["text"]))).alias("rendered"))
    return sizes.join(gone, "conv_id", "left").join(rendered, "conv_id", "left").select("conv_id", "n_turns", F.col("absorbed_by").isNull().alias("kept"), "absorbed_by", "rendered")


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM conversations GROUP BY conv_id
), longer AS (
  SELECT a.conv_id, min(b.conv_id) AS by_longer FROM c a JOIN c b
  ON b.turns[1] = a.turns[1] AND b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns GROUP BY a.conv_id
), eq AS (
  SELECT a.conv_id, min(b.conv_id) AS by_equal FROM c a JOIN c b ON b.turns = a.turns AND b.conv_id < a.conv_id GROUP BY a.conv_id
), g AS (
  SELECT c.*, coalesce(by_longer, by_equal) AS absorbed_by FROM c LEFT JOIN longer USING (conv_id) LEFT JOIN eq USING (conv_id)
)
SELECT conv_id, n_turns, absorbed_by IS NULL AS kept, absorbed_by, CASE WHEN absorbed_by IS NULL THEN rendered END AS rendered FROM g
"""
