import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import sharding


def probability(k, good, bad, draws):
    return math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)


@pytest.mark.parametrize("good, bad, draws", [(5, 7, 4), (1, 9, 10), (30, 10, 25), (3, 0, 2), (0, 5, 3)])
def test_draws_follow_the_hypergeometric_law(good, bad, draws):
    rng = np.random.default_rng(3)
    n = 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    low, high = max(0, draws - bad), min(draws, good)
    assert set(seen) <= set(range(low, high + 1))
    for k in range(low, high + 1):
        p = probability(k, good, bad, draws)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_draws_beyond_a_billion_items():
    rng = np.random.default_rng(5)
    good, bad, draws = 3 * 10**10, 5 * 10**10, 10**7
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(300)])
    spread = math.sqrt(draws * 0.375 * 0.625)
    assert abs(x.mean() - 0.375 * draws) < 5 * spread / math.sqrt(300) and 0.8 < x.std() / spread < 1.2


def test_the_matrix_has_exact_margins():
    rng = np.random.default_rng(7)
    sizes, budget = [0, 13, 1, 500, 86], sharding.shard_sizes(600, 7)
    m = sharding.matrix_rows(rng, sizes, budget)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == budget and (m >= 0).all()


def brute(rows):
    return Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t in rows)


def test_every_row_has_one_slot(tricky, corpus, nothing):
    for df in (tricky, corpus):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sharding.shard_documents(df).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == brute(rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert sorted(map(len, slots.values())) == sorted(sharding.shard_sizes(len(rows), 8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_more_shards_than_rows_cells_and_clashing_names(spark):
    df = spark.range(5, numPartitions=3).select("id", F.lit("x").alias("shard"), F.lit(1).alias("SLOT"))
    out = sharding.uniform_shards(df, shards=9)
    assert out.columns == ["id", "shard", "SLOT", "_shard", "_slot"]
    assert sorted((r["_shard"], r["_slot"]) for r in out.collect()) == [(s, 0) for s in range(5)]
    many = sharding.uniform_shards(spark.range(3000, numPartitions=5), shards=2, cell_rows=20).collect()
    assert sorted((r.shard, r.slot) for r in many) == [(s, k) for s in (0, 1) for k in range(1500)]


def test_the_arrangement_is_uniform_and_repeats_with_its_seed(spark):
    """Where each of 8 rows of 2 partitions lands, over 40 seeds, against 1/8 for every shard and slot."""
    df = spark.range(8, numPartitions=2)
    place, n = Counter(), 40
    first = {tuple(r) for r in sharding.uniform_shards(df, 2, 0).collect()}
    assert first == {tuple(r) for r in sharding.uniform_shards(df, 2, 0).collect()}
    for seed in range(n):
        place.update((r.id, 4 * r.shard + r.slot) for r in sharding.uniform_shards(df, 2, seed).collect())
    expected = n / 8
    chi = sum((place[i, s] - expected) ** 2 / expected for i in range(8) for s in range(8))
    assert chi < 49 + 5 * math.sqrt(2 * 49)  # 49 degrees of freedom


def test_partitions_beyond_one_bundle(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_GROUP", 2)
    out = sharding.uniform_shards(spark.range(101, numPartitions=7), 4).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [25, 25, 25, 26] and len({r.id for r in out}) == 101


def test_shards_are_written_whole(spark, corpus, tmp_path):
    sharding.write_shards(corpus, str(tmp_path / "s"), shards=3, seed=1, tasks=6)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in corpus.collect())
    for s in range(3):
        files = sorted((tmp_path / "s" / f"shard={s}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))
