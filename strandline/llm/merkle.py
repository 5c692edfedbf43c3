"""A Merkle manifest of a dataset: every row a leaf, a tree for each group, a tree over the groups' roots.

Bottom-up: leaves get their place within their group from range partitions, so a group may fill any number of tasks;
each level's runs of `fanout` consecutive nodes are one row, with its children, of a persisted table, whose digests are
the next level's nodes. Top-down: each level's runs join what their parents have inherited, and each child prepends its
siblings to that, so a proof never meets more than one run of a level. The proofs of the leaves, the only ones as many
as the rows, are not stored: their digest and the root that they fold to are computed where the runs are opened.

Digests are lower-case hexadecimal SHA-256 of concatenated texts, digests entering as such hexadecimal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import placed
from .common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left: string, right: string>"


def leaf_digest(values: list[Column]) -> Column:
    """H of the values: each `-` if null, else its UTF-8 byte count, `:` and itself."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, values)), 256)


def _grown(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over nodes(g, idx, n, digest, ..): for each level a stored table of runs (g, idx, n,
    digest, kids), idx and n being those of the next level's nodes; and the roots (g, depth, digest)."""
    levels, now = [], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    single = nodes.select("g", F.lit(0).alias("depth"), "digest", "n")
    roots = single.filter("n = 1")
    while most > 1:
        kid = F.struct("idx", *[c for c in now.columns if c not in ("g", "idx", "n")])
        runs = now.filter("n > 1").groupBy("g", F.floor(F.col("idx") / fanout).alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        digest = F.sha2(F.array_join(F.transform("kids", lambda x: x["digest"]), ""), 256)
        runs = runs.select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), digest.alias("digest"), "kids")
        levels.append(stored(runs, f"{name}{len(levels)}"))
        now = levels[-1].select("g", "idx", "n", "digest")
        most = -(-most // fanout)
        roots = roots.unionByName(now.filter("n = 1").select("g", F.lit(len(levels)).alias("depth"), "digest", "n"))
    return levels, stored(roots.drop("n"), f"{name}roots")


def _opened(runs: DataFrame, inherited: DataFrame) -> DataFrame:
    """The children of runs with their proofs: (g, kid, said, path), path being the child's own step before what
    inherited(g, idx, said, path) holds for the run."""
    digests = F.transform("kids", lambda x: x["digest"])
    both = runs.select("g", "idx", "kids", digests.alias("digests")).join(inherited, ["g", "idx"])
    each = both.select("g", "said", "path", "digests", F.posexplode("kids").alias("at", "kid"))
    left = F.array_join(F.expr("slice(digests, 1, at)"), "")
    right = F.array_join(F.expr("slice(digests, at + 2, size(digests))"), "")
    return each.select("g", "kid", "said", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path")).alias("path"))


def _pushed(levels: list[DataFrame], roots: DataFrame, name: str) -> DataFrame:
    """What the nodes of level 1 inherit, or, of a tree that is a single node, that node: (g, depth, idx, said, path).
    roots(g, depth, said, path) hold what is known at each tree's root, `said` being handed down as it is."""
    start = roots.select("g", "depth", F.lit(0).cast("long").alias("idx"), "said", "path")
    known = start.filter(F.col("depth") == len(levels)) if levels else start
    for k in range(len(levels) - 1, 0, -1):
        kids = _opened(levels[k], known.drop("depth")).select("g", F.lit(k).alias("depth"), F.col("kid.idx").alias("idx"), "said", "path")
        known = stored(kids.unionByName(start.filter(F.col("depth") == k)), f"{name}{k}")
    return known.unionByName(start.filter("depth = 0")) if levels else known


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fanout: int = 16, shown: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, subroot (its group's root), root, proof (array of steps left, right, from the
    leaf to the root: the digests beside the node in its run), folded_root and verified.

    A leaf is the digest of `fields`. Leaves of a group ascend by id, a null id first, and rows that agree in group and
    id by their digest; null groups are one group, which comes first, and groups ascend bytewise. `shown` replaces
    columns by what a copy under test shows for them: folded_root is what the proof makes of the copy's leaf, and
    verified whether that is the root. Null and empty values differ; a repeated row is a leaf as often as it comes.
    Columns other than `fields` are ignored, whatever their names. An empty table has no rows and no root.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    names = {c: F.col(c) for c in fields}
    told = names | (shown or {})
    group = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("n"))  # null first
    # The texts are read once; from here on a row is its id and digests.
    leaves = docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf_digest(list(names.values())).alias("digest"), leaf_digest([told[c] for c in fields]).alias("shown"))
    leaves = leaves.withColumn("shown", F.when(F.col("shown") != F.col("digest"), F.col("shown")))
    nodes = placed(leaves, ["g"], ["id", "digest"], "idx", "n")
    levels, roots = _grown(nodes, fanout, "runs")
    groups = placed(roots.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["g"], ["group"], "idx", "n")
    top_levels, top = _grown(groups, fanout, "top")
    none = F.array().cast(f"array<{_STEP}>")
    high = _pushed(top_levels, top.select("g", "depth", F.col("digest").alias("said"), none.alias("path")), "toppath")
    lone = groups.filter("n = 1").join(high.filter("depth = 0").select("g", "said", "path"), "g").select("group", "digest", "said", "path")
    of_groups = lone
    if top_levels:
        of_groups = lone.unionByName(_opened(top_levels[0], high.filter("depth > 0").drop("depth")).select(F.col("kid.group").alias("group"), F.col("kid.digest").alias("digest"), "said", "path"))
    of_groups = stored(of_groups, "groups").select(F.col("group").alias("g"), F.struct(F.col("digest").alias("subroot"), F.col("said").alias("root")).alias("said"), "path")
    below = _pushed(levels, roots.select("g", "depth").join(of_groups, "g"), "path")
    out = nodes.filter("n = 1").join(below.filter("depth = 0").select("g", "said", "path"), "g").select("id", F.col("digest").alias("leaf"), "shown", "said", "path")
    if levels:
        out = out.unionByName(_opened(levels[0], below.filter("depth > 0").drop("depth")).select("kid.id", F.col("kid.digest").alias("leaf"), "kid.shown", "said", "path"))
    folded = F.aggregate("path", F.coalesce("shown", "leaf"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    whole = out.withColumn("folded_root", folded)
    return whole.select(F.col("id").alias(id_col), "leaf", "said.subroot", "said.root", F.col("path").alias("proof"), "folded_root", (F.col("folded_root") == F.col("said.root")).alias("verified"))


def proof_sha256(proof: Column) -> Column:
    """H of a proof's siblings in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def lowered(text: str, id_col: str) -> Column:
    """The text as a tampered copy shows it: A-Z in lower case where 5 divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col(text))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents with its proofs as digests, held against a copy with lowered texts."""
    out = manifest(docs, shown={"text": lowered("text", "doc_id")})
    return out.select("doc_id", "leaf", "subroot", "root", proof_sha256(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def _levels_sql(name: str, base: str) -> str:
    up = f"SELECT level + 1 AS level, g, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (max(n) + 15) // 16 AS n FROM {name} WHERE n > 1 GROUP BY level, g, idx // 16"
    return f"{name} AS ({base} UNION ALL {up})"


def _steps_sql(levels: str) -> str:
    sides = ", ".join(f"coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx {op} a.idx), '') AS {side}" for op, side in (("<", "l"), (">", "r")))
    return f"SELECT a.level, a.g, a.idx, {sides} FROM {levels} a JOIN {levels} b ON a.level = b.level AND a.g = b.g AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.level, a.g, a.idx"


def _leaf_sql(text: str) -> str:
    part = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    return "sha256(" + " || ".join([*map(part, FIELDS[:-1]), part(text)]) + ")"


#: DuckDB has no CRC-32: it is folded bit by bit over the digits of an id.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT *, CASE WHEN {_CRC_SQL} % 5 = 0 THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END AS told FROM documents
), d AS (
  SELECT doc_id, coalesce('v' || source, 'n') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql("told")} AS shown FROM t
), p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d
), {_levels_sql("lv", "SELECT 0 AS level, g, idx, leaf AS digest, n FROM p")},
sub AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
{_levels_sql("tv", "SELECT 0 AS level, '' AS g, idx, digest, n FROM sub")},
ls AS ({_steps_sql("lv")}), ts AS ({_steps_sql("tv")}),
steps AS (
  SELECT p.g, p.idx, ls.level, ls.l, ls.r FROM p JOIN ls ON ls.g = p.g AND ls.idx = p.idx // (16 ** ls.level)::BIGINT
  UNION ALL
  SELECT p.g, p.idx, 1000 + ts.level, ts.l, ts.r FROM p JOIN sub USING (g) JOIN ts ON ts.idx = sub.idx // (16 ** ts.level)::BIGINT
), w AS (
  SELECT g, idx, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS path FROM steps GROUP BY g, idx
), f AS (
  SELECT p.doc_id, p.leaf, sub.digest AS subroot, (SELECT digest FROM tv WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(shown, coalesce(path, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN sub USING (g) LEFT JOIN w ON w.g = p.g AND w.idx = p.idx
)
SELECT *, folded_root = root AS verified FROM f
"""
