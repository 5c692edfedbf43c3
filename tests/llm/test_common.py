import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, swap_packing, tokens


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_of_paths_hubs_and_random_graphs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 80)]
    edges += [(1000, 1001 + i) for i in range(300)]
    edges += [(rng.randint(2000, 2150), rng.randint(2000, 2150)) for _ in range(90)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    want = {x: c for x, c in brute(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fresh_names():
    assert common.fresh("k", ["a", "b"]) == "k" and common.fresh("k", ["K", "_k"]) == "__k"


def test_stored_tables_can_be_cleared(spark):
    df = common.stored(spark.range(5).toDF("x"), "some")
    assert df.count() == 5
    common.clear_stored(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_small_batches_bound_what_a_worker_is_given(spark):
    """One task, 20 MB of texts: pieces of a few MB, and the session's setting as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    with common.small_batches(spark):
        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 3 and max(found) < 6 << 20 and sum(found) >= 20_000_000
    assert spark.conf.get(name) == before


def test_packing_hands_its_workers_small_batches(spark, monkeypatch):
    """The stage's texts come in small batches, and the memory of words stays small."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    stored = swap_packing.checkpointed
    monkeypatch.setattr(swap_packing, "checkpointed", lambda df: seen.append(spark.conf.get(name)) or stored(df))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert swap_packing.swap_packing(docs, path).count() == 2
    assert [int(x) for x in seen] == [4 << 20]
    table = tokens.PieceTokenizer(path).table
    assert table.keys.nbytes + table.ids.nbytes + table.n.nbytes <= 32 << 20
