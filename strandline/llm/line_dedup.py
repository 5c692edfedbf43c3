"""Line deduplication by content-defined chunks.

A document's lines are hashed; a rolling hash covers each line and the `window - 1` before it (each shifted by seven
bits more, then xor). A chunk ends after a line whose finalised rolling hash is lower than that of the line before and
no higher than that of the line after: so boundaries depend on nearby lines only, an inserted or removed line shifts
none of the others, and no two boundaries are adjacent, which gives chunks of two lines at least (but for a document's
last) and three on average. Chunks of two lines or more that occur more than once, in one document or several, are told
apart by their bytes, in an aggregation whose group key holds the chunk itself and which combines copies map-side. The
first occurrence, by document id and place, stays; the others are removed.

A repeated passage seldom begins and ends at a boundary. So a removal is extended line by line over the neighbouring
chunk, as far as its lines have the same 64-bit hashes as those beside the first occurrence and where that neighbour is
not itself repeated. What an extension removes thus stands beside an earlier occurrence that stays.

Everything is DataFrame operations. A common chunk meets its verdict in an equi-join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHIFT = 7


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2) -> DataFrame:
    """(id, chunk, lo, hi, body, before, after) of every chunk: lines lo..hi-1 of the text, joined by line feeds, and
    the line hashes of the chunks before and after it; null is empty."""
    # Each step binds its array to a lambda's variable: written as columns, the optimizer would merge the steps and
    # evaluate an outer array anew for every element of the inner one.
    rolling = " ^ ".join("element_at(a.h, i)" if k == 0 else f"IF(i > {k}, shiftleft(element_at(a.h, greatest(i - {k}, 1)), {SHIFT * k}), 0L)" for k in range(window))
    low = "element_at(b.r, i) < element_at(b.r, greatest(i - 1, 1)) AND element_at(b.r, i) <= element_at(b.r, least(i + 1, size(b.r)))"
    ends = f"filter(sequence(1, size(b.r)), i -> i = size(b.r) OR (i > 1 AND {low}))"
    body = "array_join(slice(b.lines, lo + 1, e - lo), '\n')"
    before = "IF(j = 0, slice(b.h, 1, 0), slice(b.h, IF(j = 1, 0, element_at(ends, greatest(j - 1, 1))) + 1, lo - IF(j = 1, 0, element_at(ends, greatest(j - 1, 1)))))"
    after = "IF(e = size(b.r), slice(b.h, 1, 0), slice(b.h, least(e + 1, size(b.r)), element_at(ends, least(j + 2, size(ends))) - e))"
    spans = f"""
      flatten(transform(array(split(coalesce(text, ''), '\n', -1)), lines ->
        flatten(transform(array(struct(lines AS lines, transform(lines, x -> xxhash64(x)) AS h)), a ->
          flatten(transform(array(struct(a.lines AS lines, a.h AS h, transform(sequence(1, size(a.h)), i -> xxhash64({rolling})) AS r)), b ->
            flatten(transform(array({ends}), ends ->
              transform(ends, (e, j) -> element_at(transform(array(IF(j = 0, 0, element_at(ends, greatest(j, 1)))), lo ->
                struct(j AS chunk, lo AS lo, e AS hi, {body} AS body, {before} AS before, {after} AS after)), 1))))))))))
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.select("id", F.inline(F.expr(spans)))




def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2) -> DataFrame:
    """(id, lo, hi) of the lines to remove; ranges of one document do not overlap."""
    several = chunks(docs, id_col, text_col, window).filter("id IS NOT NULL AND hi - lo >= 2").filter(F.col("body").rlike(r"[^\x20\x09-\x0D]"))
    first = F.min(F.struct("id", "chunk", "before", "after")).alias("first")
    bodies = several.withColumn("h", F.xxhash64("body")).groupBy("h", "body").agg(F.count("*").alias("n"), first)
    repeated = checkpointed(bodies.filter("n > 1").select(F.sha2("body", 256).alias("key"), "first"))
    places = several.select("id", "chunk", "lo", "hi", "before", "after", F.sha2("body", 256).alias("key"))
    met = places.join(repeated, "key").distinct()  # rows that repeat an id are one document
    stays = F.expr("id = first.id AND chunk = first.chunk").alias("stays")
    back = met.withColumn("x", F.reverse("before")).withColumn("y", F.reverse("first.before")).withColumn("u", F.col("after")).withColumn("v", F.col("first.after"))
    pad = lambda a, b: f"transform(sequence(1, greatest(1, least(size({a}), size({b})))), i -> struct(get({a}, i - 1) AS `0`, get({b}, i - 1) AS `1`))"
    count = lambda a, b: f"IF(least(size({a}), size({b})) = 0, 0, aggregate({pad(a, b)}, struct(true AS go, 0 AS n), (s, z) -> IF(s.go AND z.`0` = z.`1`, struct(true AS go, s.n + 1 AS n), struct(false AS go, s.n AS n)), s -> s.n))"
    sized = back.select("id", "chunk", "lo", "hi", stays, F.expr(count("x", "y")).alias("up"), F.expr(count("u", "v")).alias("down"))
    order = Window.partitionBy("id").orderBy("chunk")
    # A neighbour that is itself repeated is left to its own verdict.
    wide = sized.select(
        "id", "chunk", "stays",
        (F.col("lo") - F.when(F.lag("chunk").over(order) == F.col("chunk") - 1, 0).otherwise(F.col("up"))).alias("lo"),
        (F.col("hi") + F.when(F.lead("chunk").over(order) == F.col("chunk") + 1, 0).otherwise(F.col("down"))).alias("hi"),
    ).filter("NOT stays")
    return wide.select("id", F.greatest("lo", F.lag("hi").over(order)).alias("lo"), "hi")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, clean_text.

    A null text counts as empty: one empty line. Chunks without a word are left alone. A document all of whose
    chunks go is left with an empty text. Rows that repeat an id are one document and stay alike; rows with a null id
    are passed on as they are and remove nothing elsewhere. Other columns are ignored; an empty table gives no rows.
    """
    # Written first, so that the join is of two plain exchanges, which an id that many rows repeat may split.
    gone = checkpointed(removals(docs, id_col, text_col, window).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts")))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.lit(None).cast(gone.schema["cuts"].dataType)
    joined = base.filter("id IS NOT NULL").join(gone, "id", "left").unionByName(base.filter("id IS NULL").withColumn("cuts", none))
    # What stays lies between the cuts, which are in order: from each one's end to the next one's start.
    kept = """
      element_at(transform(array(split(text, '\n', -1)), lines -> array_join(flatten(
        transform(sequence(0, size(cuts)), j -> element_at(transform(array(IF(j = 0, 0, element_at(cuts, greatest(j, 1)).hi)), lo ->
          slice(lines, lo + 1, IF(j = size(cuts), size(lines), element_at(cuts, least(j + 1, size(cuts))).lo) - lo)), 1))), '\n')), 1)
    """
    clean = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.expr(kept))
    removed = F.coalesce(F.expr("aggregate(cuts, 0, (a, c) -> a + c.hi - c.lo)"), F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(id_col), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), removed.alias("n_removed"), clean.alias("clean_text"))
