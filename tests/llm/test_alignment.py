import glob
import hashlib
import os
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import alignment
from strandline.llm.common import shared_dir
from strandline.llm.tokens import _byte_of_letter

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "▁", "a▁b c", "tab\tand  two spaces", " leading", "trailing ", "\nfirst line", "a\n\nb", "a \n b", "line\nend\n", "don't 'll it's", "<|endoftext|> <s> </s> <unk>", "<0x41> x", "漢字かな交じり文 ｆｕｌｌ",
    "é é ﬁ", " nbsp 　wide", "zero​width ​ x", "\x00 nul\x00", "🙂🙂 👩‍👩‍👧 x", "1234567890 3.14 1,000", "x" * 700, "-" * 300 + " " * 50 + "=" * 200, "a b c  d", "q\r\nr", "\x1c y \x85z", "a.b\nc,d ef", "ÀÉÎ õü ß",
]


def tokens(texts):
    """(ids, byte strings) by both libraries for each text, or None."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    letters = _byte_of_letter()
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    raw = alignment.piece_bytes(second)
    for t in texts:
        if not t:
            yield None
            continue
        e = first.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in x)) for i, x in zip(e.ids, e.tokens)]
        b = [(i, raw[i]) for i in second.encode(t)]
        whole = (" " + t).encode()
        yield (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    docs, counts = [], Counter()
    for found in tokens([t for _, t in rows]):
        if found is None:
            docs.append(None)
            continue
        a, b = map(spans, found)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(tuple(",".join(str(i) for i, s, e in x if low <= s and e <= c) for x in (a, b)))
            low = c
        links, start = [], 0
        for i, s, e in a:
            while start < len(b) and b[start][2] <= s:
                start += 1
            k = start
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(set(links))
        docs.append((len(a), len(b), len(groups), links, ";".join("|".join(g) for g in groups)))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for (d, _), x in zip(rows, docs):
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(counts[p] == most[p[0]] for p in x[3])
            out.append((d, x[0], x[1], x[2], len(x[3]), best, sum(counts[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest()))
    return Counter(out)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark, tricky):
    rows = [(500 + i, t) for i, t in enumerate(ODD)] + [(900 + i, f"{t} x {t}") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_matches_the_libraries_on_whole_texts(spark, sf, odd, tricky):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(odd).unionByName(tricky.select("doc_id", "text"))
    got = Counter(map(tuple, alignment.alignment_digests(df, A, B).collect()))
    assert got == brute(rows_of(df))


@pytest.mark.parametrize("common", [1, 40])
def test_few_common_words_give_the_same(corpus, odd, common):
    df = corpus.limit(60).unionByName(odd)
    out = alignment.align(df, A, B, common=common).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest(r.groups)) for r in out) == brute(rows_of(df))


def test_empty_table_and_clashing_columns(nothing, tricky):
    assert alignment.align(nothing, A, B).count() == 0
    named = tricky.select("doc_id", "text").toDF("word", "full")
    out = alignment.align(named, A, B, id_col="word", text_col="full")
    assert out.columns[0] == "word" and out.count() == tricky.count()


def test_the_core_takes_any_tokens(spark):
    """AB|CDE|F against A|BCD|E|F: cuts after E and F."""
    a = spark.createDataFrame([(0, 0, 10, 2), (0, 1, 11, 3), (0, 2, 12, 1)], "doc long, pos int, id int, n int")
    b = spark.createDataFrame([(0, 0, 20, 1), (0, 1, 21, 3), (0, 2, 22, 1), (0, 3, 23, 1)], "doc long, pos int, id int, n int")
    rows = alignment.aligned(a, b)
    assert [(r.la, r.lb) for r in rows.orderBy("end").collect()] == [(10, 20), (10, 21), (11, 21), (11, 22), (12, 23)]
    (r,) = alignment.described(rows).collect()
    assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (3, 4, 2, 5, "10,11|20,21,22;12|23")


def test_a_model_that_joins_words_is_not_cut():
    assert alignment.boundary(A, B) == alignment._BOUNDARY
    assert alignment.boundary(public_tokenizers.path("word_bpe_49k.json"), B) == alignment._NOWHERE


def test_the_result_splits_and_regroups_no_text(corpus):
    """Documents come as numbers of words: what is left for the result neither splits texts nor explodes their words."""
    plan = alignment.align(corpus.limit(20), A, B)._jdf.queryExecution().toString().lower()
    assert "split(" not in plan and "explode" not in plan


def test_steps_that_nothing_reads_any_more_leave_the_disk(spark, corpus):
    before = set(glob.glob(f"{shared_dir(spark)}/strandline/*/*"))
    out = alignment.align(corpus, A, B, common=4)
    left = {os.path.basename(x).split("-")[0] for x in set(glob.glob(f"{shared_dir(spark)}/strandline/*/*")) - before}
    assert left and not left & {"full", "vocabulary", "tokens", "words", "rare", "weights"}
    assert out.count() == corpus.count()


def test_words_in_buckets_meet_without_being_moved(spark, corpus):
    words = corpus.select(F.explode(F.split("text", " ")).alias("w")).filter("w != ''").select(F.concat(F.lit(" "), "w").alias("word")).distinct().withColumn("wid", F.monotonically_increasing_id())
    facts, unspelt = alignment.aligned_words(words, A, B)
    assert facts.count() == words.count() and unspelt.count() == 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rare = alignment._bucketed(words.select("wid", F.lit(1).alias("k")).repartition(n, "wid"), "wid", n, "rare")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rare.join(facts.withColumnRenamed("doc", "wid"), "wid")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_texts_that_go_on_over_batches_come_whole(spark):
    """Texts of 1, 2, ... tokens, each a group, in batches of three rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        tokens = spark.createDataFrame([(d, p, 10 + p, 1) for d in range(12) for p in range(d + 1)], "doc long, pos int, id int, n int")
        rows = alignment.described(alignment.aligned(tokens, tokens)).collect()
    finally:
        spark.conf.set(name, before)
    assert {r.doc: r.groups for r in rows} == {d: ";".join(f"{10 + p}|{10 + p}" for p in range(d + 1)) for d in range(12)}
    assert all((r.n_a, r.n_b, r.n_groups, r.n_links, len(r.links)) == (r.doc + 1,) * 5 for r in rows)


@pytest.mark.parametrize("most", [0, 1, 3, 4, 100])
def test_the_most_frequent_words_and_no_more_than_asked(spark, most):
    uses = [5, 5, 5, 3, 2, 2]
    words = spark.createDataFrame([(i, f"w{i}", u) for i, u in enumerate(uses)], "wid long, word string, uses long")
    found = alignment._frequent(words, most)["wid"].to_pylist()
    assert len(found) <= most and len(set(found)) == len(found)
    kept = [uses[i] for i in found]
    assert kept == sorted(kept, reverse=True) and all(u in kept or sum(v >= u for v in uses) > most for u in uses)


def test_numbers_beyond_the_short_ones():
    words = [f"w{i}" for i in range(alignment._LONG + 3)]
    docs = pa.array([[words[-1], "rare", words[0], words[alignment._LONG], words[alignment._LONG - 1]], [], [words[-2]]])
    held = type("Held", (), {"value": pa.array(words)})
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([7, 8, 9]), docs], names=["k", "id", "words"])
    (out,) = alignment._numbered(held)([batch])
    n = alignment._LONG
    assert alignment._codes(out.column("codes"), out.column("long")).tolist() == [n + 2, -1, 0, n, n - 1, n + 1]
    assert out.column("rare").to_pylist() == [[{"pos": 1, "word": "rare"}], [], []]


def test_shuffle_files_are_swept_while_steps_are_written_only(spark, corpus, monkeypatch):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, bucketed = spark.conf.get(name), alignment._bucketed
    monkeypatch.setattr(alignment, "_bucketed", lambda *args: (seen.append(spark.conf.get(name)), bucketed(*args))[1])
    alignment.align(corpus.limit(20), A, B)
    assert seen and set(seen) == {"true"} and spark.conf.get(name) == before
