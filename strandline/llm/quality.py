"""Quality rules as a bitmask ledger.

Each document is read once: the ledger holds its measurements and one integer whose bit i says that rule i failed.
Policies are sets of rules with a version: a document passes one when `failed & mask` has no bit. Verdicts of any
number of policies, and ablations (what a policy would reject without one of its rules), are bitwise aggregations
over the ledger; no text is read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_SPLIT = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})

#: The rules by bit: name and the SQL condition, on the measurements, under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > 2 * n_words AND n_symbols >= 10"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines AND n_dup_lines >= 3"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("shouting", "10 * n_upper > 6 * n_letters AND n_letters >= 50"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << bit(r) for r in self.rules)


def bit(rule: str) -> int:
    return [name for name, _ in RULES].index(rule)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(name for name, _ in RULES))
POLICIES = (BASE, STANDARD)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows of `window` (a power of two) words that occur at least twice in ids."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, size = ids, 1
    while size < window:  # rank of the windows of twice the size: exact, without hashing
        width = int(rank.max()) + 1
        rank = np.unique(rank[:-size].astype(np.int64) * width + rank[size:], return_inverse=True)[1]
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text; null counts as empty. Words are runs without the space and U+0009..U+000D."""
    if not text:
        return (0,) * len(MEASURES)
    # str.split() without an argument would split at more characters; one kind of separator first, then empty parts out.
    words = [w for w in text.translate(_SPLIT).split(" ") if w]
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n_lines += 1
            if line in lines:
                n_dup += 1
            else:
                lines.add(line)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.bincount(points[points < 128], minlength=128)
    upper, lower = int(small[65:91].sum()), int(small[97:123].sum())
    spaces = int(small[32] + small[9:14].sum())
    symbols = int(sum(small[ord(c)] for c in SYMBOLS))
    repeats = repeat_words(ids) if len(seen) < len(words) else 0
    return len(words), len(points) - spaces, symbols, n_dup, repeats, n_lines, upper, upper + lower


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=["id", *MEASURES])


def _failed(prefix: str = "") -> str:
    """SQL for the bitmask, over the measurements with a prefix to their names."""
    conditions = [re.sub("|".join(MEASURES), lambda m: prefix + m[0], c) for _, c in RULES]
    return " | ".join(f"CASE WHEN {c} THEN {1 << i}L ELSE 0L END" for i, c in enumerate(conditions))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, the measurements and `failed`, the bitmask of failed rules.

    Null text has no words and no lines. Repeated rows are measured each. Other columns are ignored; an empty table
    gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    measured = two.mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failed", F.expr(_failed())).withColumnRenamed("id", id_col)


def verdict(policy: Policy):
    """Whether a ledger row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a boolean <name>_v<version> for each policy."""
    return rows.select("*", *(verdict(p).alias(f"{p.name}_v{p.version}") for p in policies))


def ablations(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that only it rejects, rows that pass without it.

    One aggregation over the ledger's bits, of fixed size whatever the input.
    """
    by_bits = rows.groupBy("failed").agg(F.count("*").alias("n"))  # at most 2^rules rows
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    per_rule = by_bits.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << bit(r)).cast("long").alias("b")) for r in policy.rules])).alias("r"), hit.alias("hit"), "n").select("r.rule", "r.b", "hit", "n")
    return per_rule.groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("b"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not(F.col("b"))) == 0, F.col("n")).otherwise(0)).alias("n_pass_without"),
    )


def quality_rules(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored ledger's digest: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed (the bitmask). One row per row of docs.

    Null and empty texts have no words and fail the base. Repeated rows are judged each; a null id is passed on. Other
    columns are ignored whatever their names. An empty table gives no rows.
    """
    rows = stored(ledger(docs, id_col, text_col), "quality")
    base = ~verdict(BASE)
    return rows.select(id_col, *MEASURES[:5], base.alias("base_failed"), (~base & verdict(policy)).alias("kept"), "failed")


def keep_good(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the policy and the base, with their columns, whatever their names: the rules run
    beside the row, so nothing is joined or shuffled. Null and empty texts go; repeated rows stay together; an empty
    table gives no rows."""
    prefix = "rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            found = np.array([measure(t.as_py()) for t in b.column(at)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=[*b.schema.names, *(prefix + m for m in MEASURES)])

    schema = StructType([*docs.schema.fields])
    for m in MEASURES:
        schema = schema.add(prefix + m, "long")
    seen = docs.mapInArrow(judge, schema)
    return seen.filter(F.expr(_failed(prefix)).bitwiseAND(F.lit((policy.mask | BASE.mask))) == 0).drop(*(prefix + m for m in MEASURES))
