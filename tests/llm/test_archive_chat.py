import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", h, "x") for i, h in enumerate(["<a>", "<b>", "<a>", "", None, "é" * 400, "<b>", "<a>"])]
    rows += [(2, "http://h/2", "<a>", "again"), (20, None, "<lone>\r\n", None), (None, "http://none", "<a>", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string").repartition(3)


def brute(rows, least=0):
    last = {}
    for p, h in rows:
        last[h] = max(last.get(h, -1), -1 if p is None else p)
    out = []
    for p, h in rows:
        raw = h.encode()
        own = p == last[h] or len(raw) < least
        out.append((p, len(raw), warc.sha1_base32(raw), "response" if own else "revisit", None if own else last[h]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(pages, least):
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    assert sorted(map(tuple, warc.archive_round_trip(pages, least).collect()), key=str) == brute(rows, least)


@pytest.mark.parametrize("least", [0, 4])
def test_payloads_are_stored_once_and_records_come_back(spark, pages, least):
    archive = warc.write_archive(pages, least)
    store = spark.read.table(archive.payloads)
    assert store.count() == len({r.html or "" for r in pages.collect()})
    said = sorted(map(tuple, warc.read_archive(spark, archive).collect()), key=str)
    records = [bytes(r.record) for r in warc.record_bytes(spark, archive).collect()]
    last = {}
    for r in pages.collect():
        last[r.html or ""] = max(last.get(r.html or "", (-1, "")), (-1 if r.page_id is None else r.page_id, r.url or ""))
    for data in (b"".join(records), b"".join(map(gzip.compress, records))):
        parsed = list(warc.parse_records(data))
        found, ids, targets = [], {}, []
        for head, block in parsed:
            page = int(head["X-Page-ID"]) if head.get("X-Page-ID") else None
            ids[head["WARC-Record-ID"]] = page
            if head["WARC-Type"] == "response":
                assert head["WARC-Payload-Digest"] == "sha1:" + warc.sha1_base32(block)
            else:
                assert block == b"" and head["WARC-Profile"] == warc.REVISIT_PROFILE
            targets.append((page, head["WARC-Payload-Digest"][5:], head["WARC-Type"], head.get("WARC-Refers-To")))
        for page, digest, kind, refers in targets:
            found.append((page, digest, kind, None if refers is None else ids[refers]))
        assert sorted(found, key=str) == sorted(((p, d, k, r) for p, _, d, k, r in said), key=str)
    with pytest.raises(ValueError):
        list(warc.parse_records(records[0][:-3]))


def test_a_changed_payload_is_noticed(spark, pages):
    archive = warc.write_archive(pages)
    spark.read.table(archive.payloads).withColumn("payload", F.lit(b"x")).write.saveAsTable("changed_payloads", path=archive.path + "/changed")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, warc.Archive("changed_payloads", archive.first, archive.others, archive.path)).collect()
    spark.sql("DROP TABLE changed_payloads")


def test_responses_are_put_together_without_moving_payloads(spark, pages):
    archive = warc.write_archive(pages)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.responses(spark, archive)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Join" in plan


def test_empty_archive(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_chats(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    none_first = lambda v: (v is not None, v if v is not None else 0)
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: (none_first(z[0]), (z[1] is not None, z[1] or ""), (z[2] is not None, z[2] or "")))] for c, v in convs.items()}
    out = {}
    for c, v in turns.items():
        longer = [d for d, w in turns.items() if len(w) > len(v) and w[: len(v)] == v]
        equal = [d for d, w in turns.items() if w == v and d < c]
        by = min(longer) if longer else min(equal) if equal else None
        text = None if by is not None else "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v)
        out[c] = (len(v), by is None, by, text)
    return out


def test_chats_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.randint(1, 5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", "", None]) if t else "hello", 1) for t in range(n)]
    rows += [(100, 0, None, None, 1), (101, 0, None, "", 1), (102, 0, "", None, 1), (None, 0, "user", "lost", 1), (103, 0, "user", "long " * 3000, 1), (104, 0, "user", "b", 1), (104, 0, "user", "a", 1), (104, None, "user", "z", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, k int").repartition(4)
    got = {r.conv_id: (r.n_turns, r.kept, r.absorbed_by, r.rendered) for r in chat.format_chats(df).collect()}
    assert got == brute_chats(rows)
    assert chat.format_chats(spark.createDataFrame([], df.schema)).count() == 0


def test_a_hash_alone_drops_nothing(spark, monkeypatch):
    """Were all hashes equal, the turn-by-turn check would keep what differs."""
    monkeypatch.setattr(chat, "_mixed", lambda salt: F.lit(1).cast("decimal(20,0)"))
    rows = [(c, t, "user", f"{c} {t}") for c, n in ((1, 2), (2, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert all(r.kept for r in chat.format_chats(df).collect())


def test_buckets_stay_within_the_limit():
    for tb in (0, 1, 10, 100, 1000):
        for partitions in (1, 7, 200, 30_000, 200_000):
            n = warc.bucket_count(tb * 10**12, partitions)
            assert 1 <= n <= 100_000 and (n % partitions == 0 or partitions > 100_000)
    assert warc.bucket_count(640 << 20, 2) == 10 and warc.bucket_count(1, 8) == 8


def test_one_file_a_bucket_of_payloads(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id % 3000) AS html")
    archive = warc.write_archive(pages, path=str(tmp_path / "a"), buckets=12)  # three times the partitions
    files = list((tmp_path / "a" / "payloads").glob("*.parquet"))
    assert len(files) == 12
    assert spark.read.table(archive.payloads).count() == 3000
