import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from strandline.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(t):
    return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(digests, fanout):
    """The root and each leaf's steps."""
    steps = [[] for _ in digests]
    members = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, groups = [], []
        for a in range(0, len(digests), fanout):
            run = digests[a : a + fanout]
            for k in range(len(run)):
                for leaf in members[a + k]:
                    steps[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            groups.append(sum(members[a : a + fanout], []))
        digests, members = up, groups
    return digests[0], steps


def brute(rows, fanout=16):
    by = defaultdict(list)
    for r in rows:
        leaf = H(*map(value, r))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by[r[1]].append(((r[0] is not None, r[0] or 0), leaf, r[0], H(*map(value, (*r[:4], lower(r[4]) if hit else r[4])))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([x[1] for x in sorted(by[s])], fanout) for s in order}
    root, top = tree([below[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, top):
        for (_, leaf, d, shown), steps in zip(sorted(by[s]), below[s][1]):
            path = steps + up
            now = shown
            for a, b in path:
                now = H(a, now, b)
            out.append((d, leaf, below[s][0], root, H(*(a + b for a, b in path)), now, now == root))
    return Counter(out)


def rows_of(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_matches_brute_force(spark, tricky, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (tricky, docs):
        got = Counter(map(tuple, merkle.merkle_manifest(df).collect()))
        assert got == brute(rows_of(df))


def test_any_fanout_many_groups_lone_leaves(spark):
    rows = [(i, f"s{i % 23}" if i % 7 else None, None, i, f"Text {i}") for i in range(300)] + [(1000, "alone", "en", 3, "A"), (1001, "alone two", "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    for fanout in (2, 3, 16):
        shown = {"text": merkle.lowered("text", "doc_id")}
        out = merkle.manifest(df, fanout=fanout, shown=shown)
        out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_sha256(F.col("proof")), "folded_root", "verified")
        assert Counter(map(tuple, out.collect())) == brute(rows, fanout)


def test_one_row_one_group_and_none(spark, nothing):
    assert merkle.merkle_manifest(nothing).count() == 0
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(7, "s", "en", 1, "B")], kind)
    (r,) = merkle.merkle_manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("")
    same = spark.createDataFrame([(7, "s", "en", 1, "b")] * 40, kind)  # a repeated row
    assert Counter(map(tuple, merkle.merkle_manifest(same).collect())) == brute([(7, "s", "en", 1, "b")] * 40)


def test_any_change_is_seen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert merkle.manifest(docs).filter("NOT verified").count() == 0
    moved = merkle.manifest(docs, shown={"lang": F.lit("xx")})
    assert moved.filter("verified").count() == 0
    assert moved.select("root").distinct().count() == 1


def test_sql_agrees_on_odd_rows(tricky):
    con = duckdb.connect()
    con.register("documents", tricky.select(*merkle.FIELDS).toArrow())
    want = con.sql(merkle.ORACLE_SQL).fetchall()
    assert Counter(map(tuple, merkle.merkle_manifest(tricky).collect())) == Counter(want)


def test_native(tricky):
    plan = merkle.merkle_manifest(tricky)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
