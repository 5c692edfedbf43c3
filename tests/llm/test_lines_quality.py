import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from strandline.llm import line_dedup, quality

MASK = (1 << 64) - 1


def spark_hash(x):
    """XXH64 with seed 42 of a long's eight bytes or a text's, as the engine hashes them."""
    return xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x & MASK).to_bytes(8, "little"), 42)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_chunks(text, window=2):
    """(lo, hi, body) of the chunks of a text."""
    lines = (text or "").split("\n")
    h = [spark_hash(x) for x in lines]
    r = []
    for i in range(len(lines)):
        v = 0
        for k in range(min(window, i + 1)):
            v ^= (h[i - k] << (line_dedup.SHIFT * k)) & MASK
        r.append(signed(spark_hash(v)))
    out, lo = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i > 0 and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            out.append((lo, i + 1, "\n".join(lines[lo : i + 1])))
            lo = i + 1
    return out


def alike(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute_dedup(rows):
    texts = {d: t for d, t in rows if d is not None}
    cut = {d: brute_chunks(t) for d, t in texts.items()}
    seen = {}
    for d, parts in cut.items():
        for c, (lo, hi, body) in enumerate(parts):
            if hi - lo >= 2 and re.search(r"[^\x20\x09-\x0D]", body):
                seen.setdefault(body, []).append((d, c))
    repeated = {(d, c): min(v) for v in seen.values() if len(v) > 1 for d, c in v}
    gone = {d: set() for d in texts}
    lines = lambda d, c: cut[d][c][2].split("\n") if 0 <= c < len(cut[d]) else []
    for (d, c), (fd, fc) in repeated.items():
        if (d, c) != (fd, fc):
            lo, hi, _ = cut[d][c]
            if (d, c - 1) not in repeated:
                lo -= alike(lines(d, c - 1)[::-1], lines(fd, fc - 1)[::-1])
            if (d, c + 1) not in repeated:
                hi += alike(lines(d, c + 1), lines(fd, fc + 1))
            gone[d].update(range(lo, hi))
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        drop = gone[d] if d is not None else set()
        out.append((d, len(own), len(drop), "\n".join(x for i, x in enumerate(own) if i not in drop)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lined(spark):
    rng = np.random.default_rng(1)
    passage = [f"shared line {i}" for i in range(12)]
    rows = []
    for i in range(60):
        own = [f"own {i} {j} {rng.integers(9)}" for j in range(int(rng.integers(1, 9)))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((i, "\n".join(own[:at] + (passage if i % 3 else []) + own[at:]), 7, "x"))
    rows += [(60, None, 1, None), (61, "", 1, None), (62, "\n\n\n", 1, None), (63, "\n\n\n", 1, None), (None, "\n".join(passage), 1, None), (3, rows[3][1], 1, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lines long, id string").repartition(4)


def test_line_dedup_matches_brute_force(lined, tricky, nothing):
    for df in (lined, tricky):
        got = line_dedup.line_dedup(df)
        assert sorted(map(tuple, got.collect()), key=str) == brute_dedup([(r.doc_id, r.text) for r in df.collect()])
    assert line_dedup.line_dedup(nothing).count() == 0


def test_shared_passages_go_but_once(lined):
    got = line_dedup.line_dedup(lined).collect()
    # 40 documents hold the twelve lines, and the first keeps them. Own lines beside them may hide an edge of a few.
    assert 0.95 * 39 * 12 <= sum(r.n_removed for r in got) <= 39 * 12
    assert sum("shared line 5\nshared line 6" in r.clean_text for r in got if r.doc_id is not None) == 1


def test_share_of_short_passages_that_go(spark):
    """What README states: the share of the lines of a passage that go where it repeats in other surroundings."""
    rng = np.random.default_rng(2)
    shares = {}
    for size in (4, 8, 16):
        rows = []
        for k in range(60):
            for copy in range(2):
                own = [f"own {size} {k} {copy} {j}" for j in range(20)]
                at = int(rng.integers(1, 19))
                rows.append((len(rows), "\n".join(own[:at] + [f"passage {size} {k} {j}" for j in range(size)] + own[at:])))
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        shares[size] = sum(r.n_removed for r in got) / (60 * size)
    assert shares[4] <= shares[8] <= shares[16] <= 1 and shares[8] > 0.5 and shares[16] > 0.95, shares
    print(shares)


def test_repeated_and_null_ids_do_not_gather(spark, lined):
    rows = [(None if i % 2 else 5, "a b\nc d\ne f\ng h") for i in range(400)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and all(r.clean_text == "a b\nc d\ne f\ng h" for r in got)


def test_boundaries_resist_shifts():
    lines = [f"line {i} of a text" for i in range(60)]
    a = {b for _, _, b in brute_chunks("\n".join(lines))}
    b = {b for _, _, b in brute_chunks("\n".join(["new", *lines]))}
    assert len(a & b) >= len(a) - 2


def test_line_dedup_plan_is_native(lined):
    plan = line_dedup.line_dedup(lined.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_matches_brute_force(tricky, corpus, nothing):
    for df in (tricky, corpus):
        got = {}
        for r in quality.quality_rules(df).collect():
            got.setdefault(r.doc_id, []).append(tuple(r)[1:])
        want = {}
        for r in df.collect():
            m = brute_measures(r.text)
            failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
            want.setdefault(r.doc_id, []).append((*m, failed))
        assert {k: sorted(x[:6] for x in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        assert not any(x[5] and x[6] for v in got.values() for x in v)
    assert quality.quality_rules(nothing).count() == 0


def test_policies_and_ablations_follow_the_bits(corpus):
    rows = quality.ledger(corpus).cache()
    applied = quality.apply_policies(rows).collect()
    for r in applied:
        assert r.base_v1 == (r.failed & quality.BASE.mask == 0) and r.standard_v1 == (r.failed & quality.STANDARD.mask == 0)
    bits = Counter(r.failed for r in applied)
    for r in quality.ablations(rows).collect():
        b = 1 << quality.bit(r.rule)
        assert r.n_failed == sum(n for f, n in bits.items() if f & b)
        assert r.n_only == sum(n for f, n in bits.items() if f & quality.STANDARD.mask == b)
        assert r.n_pass_without == sum(n for f, n in bits.items() if f & quality.STANDARD.mask & ~b == 0)


def test_keep_good_agrees_with_the_ledger(corpus, tricky, nothing):
    for df in (corpus, tricky):
        kept = sorted(str(r.doc_id) for r in quality.keep_good(df).collect())
        assert kept == sorted(str(r.doc_id) for r in quality.quality_rules(df).filter("kept").collect())
        assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(nothing).count() == 0


def test_clean_documents_stay(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.quality_rules(docs).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed")
    assert good.count() > 0 and good.filter("NOT kept").count() == 0
