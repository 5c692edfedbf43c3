import hashlib
import re

from pyspark.sql import functions as F

from strandline.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d if d is not None else 0))
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        _, none, keep = min(g)
        keep = None if none else keep
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(tricky, corpus):
    for df in (tricky, corpus):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == brute(rows)


def test_directory_doubles_until_buckets_fit(spark, corpus):
    entries = corpus.select(F.xxhash64("text").alias("h")).distinct()
    buckets, depth = exact_dedup.build_directory(entries, capacity=8, max_depth=24)
    rows = buckets.collect()
    assert depth > 1 and all(r.n <= 8 for r in rows) and sum(r.n for r in rows) == entries.count()
    # prefixes partition the hash space: none is a prefix of another
    cells = {(r.depth, r.prefix) for r in rows}
    assert not any((d - k, p >> k) in cells for d, p in cells for k in range(1, d + 1))


def test_small_buckets_give_the_same_result(corpus):
    a = exact_dedup.exact_dedup(corpus)
    b = exact_dedup.exact_dedup(corpus, capacity=4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_one_key_that_fills_a_bucket_chains(spark):
    entries = spark.createDataFrame([(5,)] * 20, "h long")
    buckets, depth = exact_dedup.build_directory(entries, capacity=4, max_depth=6)
    assert depth == 6 and [r.n for r in buckets.collect()] == [20]


def test_collisions_are_told_apart_by_bytes(tricky, corpus):
    """With hashes of two bits, nearly all texts share one; the owners' chains and the lookup go by the texts."""
    for df in (tricky, corpus):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        for bits in (2, 6):
            got = exact_dedup.exact_dedup(df, capacity=3, max_depth=8, hash_bits=bits)
            assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    _, index = exact_dedup.build_index(corpus, capacity=3, max_depth=8, hash_bits=2)
    chains = {}
    for r in index.collect():
        chains.setdefault((r.owner, r.depth, r.bucket, r.h), []).append((r.chain, r.chained))
    assert max(len(v) for v in chains.values()) > 10
    for v in chains.values():
        assert sorted(v) == [(k, len(v)) for k in range(len(v))]


def test_a_common_text_is_combined_before_it_is_sent(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == brute(rows)


def test_the_directory_deepens_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    _, index = exact_dedup.build_index(docs)
    assert index.agg(F.min("depth")).first()[0] >= 2 and index.select("bucket").distinct().count() >= 4


def test_keep_one_and_empty(corpus, tricky, nothing):
    kept = exact_dedup.keep_one(corpus)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in corpus.collect()]
    assert kept.columns == corpus.columns and kept.count() == len(set(norm))
    assert exact_dedup.keep_one(tricky).columns == tricky.columns
    clashing = tricky.withColumnsRenamed({"id": "key", "fp": "_key", "h": "K"})
    assert exact_dedup.keep_one(clashing).columns == clashing.columns and exact_dedup.keep_one(clashing).count() == exact_dedup.keep_one(tricky).count()
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0


def test_no_python_in_the_plan(corpus):
    plan = exact_dedup.exact_dedup(corpus.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
