import itertools
import random
import re

import numpy as np
import xxhash

from strandline.llm import simhash


def brute_fp(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(d, brute_fp(t)) for d, t in rows]
    at = {}
    for d, f in fps:
        at.setdefault(f, []).append(d)
    root = {f: f for f in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(at, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    low = {}
    for f, ds in at.items():
        low.setdefault(find(f), []).extend(d for d in ds if d is not None)
    return sorted(((d, f"{f:016x}", min(low[find(f)], default=None)) for d, f in fps), key=str)


def test_matches_brute_force(tricky, corpus):
    for df in (tricky, corpus):
        got = simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id")
        assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole == brute_fp(text)


def test_masks_cover_every_pair_of_positions():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for places in itertools.combinations(range(64), radius):
            d = sum(1 << p for p in places)
            assert any(m & d == 0 for m in masks)


def test_chains_and_hot_neighbourhoods(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << i) for i in range(64)}  # all within two bits of each other
    far = rng.getrandbits(64)
    chain = [far]
    for k in range(0, 12, 2):
        chain.append(chain[-1] ^ (3 << (4 * k)))
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps | set(chain)]
    df = spark.createDataFrame(rows, "fp long")
    edges = simhash.links(df)
    assert edges.count() <= 65 * len(rows)
    from strandline.llm.common import components

    comp = {r.node & (2**64 - 1): r.component for r in components(edges).collect()}
    assert len({comp[f] for f in fps}) == 1 and len({comp[f] for f in chain}) == 1 and comp[far] != comp[next(iter(fps))]


def test_near_components_catch_similar_texts(spark, tricky, nothing):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(300)] for _ in range(20)]
    rows, n = [], 0
    shared = [f"boilerplate{i}" for i in range(60)]  # a passage that all share makes nobody alike
    for b in base:
        rows.append((n, " ".join(b + shared)))
        edited = list(b)
        for at in rng.sample(range(300), 4):
            edited[at] = "edited"
        rows.append((n + 1, " ".join(edited + shared)))
        n += 2
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i + 1] == i for i in range(0, n, 2)) >= 19 and all(got[i] in (i, i - 1) for i in range(n))
    assert simhash.near_components(nothing).count() == 0 and simhash.near_components(tricky).count() == tricky.count()


def test_every_kind_of_bucket_gives_the_same_components(spark):
    from strandline.llm.common import components

    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(64), f ^ 5 << rng.randrange(60)}
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in sorted(fps)]
    df = spark.createDataFrame(rows, "fp long")
    for radius in (1, 2):
        found = [sorted(map(tuple, components(simhash.links(df, radius, crowd)).collect())) for crowd in (0, 1, 16, 1000)]
        assert found[0] and all(f == found[0] for f in found)


def test_minhash_bands_and_sets():
    words = [f"w{i}" for i in range(400)]
    a, b = (np.unique(simhash.shingle_hashes(" ".join(w))) for w in (words, words[:200] + ["new"] + words[200:]))
    assert len(a) == 396 and len(np.intersect1d(a, b)) == 392
    assert (simhash.bands(a) == simhash.bands(b)).sum() > 25 and len(set(simhash.bands(a).tolist())) == simhash.BANDS
    assert len(simhash.bands(np.zeros(0, np.uint64))) == 0 and len(simhash.shingle_hashes("one two")) == 1 and len(simhash.shingle_hashes(None)) == 0
    for text in ("", "a b c", " ".join(words)):
        assert simhash.majority_bits(simhash.shingle_hashes(text)) == brute_fp(text, 5)


def test_keep_one(corpus, tricky, nothing):
    kept = simhash.keep_one(corpus)
    classes = simhash.near_components(corpus)
    want = {r.doc_id for r in classes.filter("doc_id = component_id").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == corpus.columns
    assert simhash.keep_one(tricky).columns == tricky.columns
    assert simhash.keep_one(nothing).count() == 0 and simhash.simhash_components(nothing).count() == 0


def jaccard_pairs(texts, words=5, least=0.8):
    """All pairs (i, j), i < j, of Jaccard similarity `least` or more on the sets of word shingles."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or {t.lower()})
    return [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def together(spark, texts):
    """(pairs of similarity 0.8 or more, those of them in one component)"""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    pairs = jaccard_pairs(texts)
    return len(pairs), sum(got[i] == got[j] for i, j in pairs)


def brute_near(rows, words=5, least=0.8):
    """The smallest id of every document's class over all covering and all Jaccard links, from all pairs."""
    fps = [brute_fp(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = [t or "" for _, t in rows]
    for i, j in jaccard_pairs(texts, words, least):
        root[find(i)] = find(j)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return {d: min(low[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_components_equal_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert got == brute_near(rows)


def test_crowded_groups_equal_all_pairs(spark):
    """Texts that agree on many MinHashes and yet are unlike; every group but the smallest is split by further bands."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(150)]
    texts = []
    for k in range(60):
        words = [*passage, *(f"own{k} {i}" for i in range(30))]
        texts.append(" ".join(words))
        words[rng.randrange(150)] = "edited"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    want = brute_near(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for crowd in (2, 16):
        got = {r.doc_id: r.component_id for r in simhash.near_components(df, crowd=crowd).collect()}
        assert got == want


def test_a_large_family_is_one_class(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:k] + ["edit" + str(rng.random())] + words[k + 1 :]) for k in (rng.randrange(120) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.component_id for r in simhash.near_components(df).collect()} == {0}
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [0]


def test_passages_in_common_lose_no_pair(spark):
    rng = random.Random(21)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(20)]
    texts = []
    for _ in range(250):
        words = " ".join(rng.sample(passages, 8)).split()
        texts.append(" ".join(words))
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    n, met = together(spark, texts)
    assert n >= 250 and met == n, (n, met)


def brute_classes(rows):
    want = brute_near(rows)
    return {d: want[d] for d, _ in rows}


def test_families_of_many_sizes_lose_no_pair(spark):
    """Texts of sizes a quarter apart around one passage, some just similar enough and some not."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(160)]
    rows = []
    for k in range(240):
        own = [f"own{k} {i}" for i in range(rng.randrange(1, 24))]
        cut = rng.randrange(0, 30)
        rows.append((k, " ".join([*passage[cut:], *own])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for crowd in (2, 16):
        got = {r.doc_id: r.component_id for r in simhash.near_components(df, crowd=crowd).collect()}
        assert got == brute_classes(rows)


def search(spark, texts):
    """A search over texts whose sets are at hand, with all keys in one band's group."""
    rows = [(k, simhash.np.unique(simhash.shingle_hashes(t, 5))) for k, t in enumerate(texts)]
    keys = spark.createDataFrame([(k, len(h), [1]) for k, h in rows], "key long, n long, bands array<long>")
    known = spark.createDataFrame([(0, 0)], "u long, v long")
    s = simhash._Search(keys, None, known, 5, 0.8, 16)
    s.sets = spark.createDataFrame([(k, bytearray(h.tobytes())) for k, h in rows], "key long, shingles binary").repartition(4)
    return s, keys.select("key")


def test_texts_around_a_passage_do_not_all_meet(spark):
    """Their passage is too short to make any two similar: no row is joined, however many they are."""
    passage = " ".join(f"p{i}" for i in range(200))
    for count in (50, 200):
        s, keys = search(spark, [passage + " " + " ".join(f"own{k}x{i}" for i in range(30)) for k in range(count)])
        assert s.rarest(keys).count() == 0


def test_members_of_a_large_family_do_not_meet_each_other(spark):
    rows = [(k, 100, 7, 1, small, 0 if k < 300 else k) for k in range(303) for small in (False, True)]
    held = spark.createDataFrame(rows, "key long, n long, g long, place long, small boolean, component long")
    s, _ = search(spark, ["a b c d e f"])
    pairs = s.placed_pairs(held)
    assert pairs.distinct().count() == 300 * 3 + 3 == pairs.count()
    joined = [m for m in pairs.select("u", "v").collect()]
    assert all(r.u >= 300 or r.v >= 300 for r in joined)


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 0), (3, a, 1), (3, b, 2), (5, b, 3), (None, b, 4), (None, "alone", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Row int").repartition(2)
    assert sorted(r.Row for r in simhash.keep_one(df).collect()) == [0, 2, 5]


def test_pairs_of_short_texts_meet(spark):
    rng = random.Random(22)
    texts = []
    for n in (20, 25, 30, 40):
        for _ in range(60):
            words = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, "more"])]
    n, met = together(spark, texts)
    assert n == 240 and met == n, (n, met)


def test_a_large_family_about_the_threshold(spark):
    """Texts about the threshold from each other: the classes are those of all pairs."""
    rng = np.random.default_rng(12)
    n, words = 240, [f"w{i}" for i in range(600)]
    texts = []
    for t in range(n):
        own = list(words)
        for at in rng.choice(600, rng.integers(6, 9), replace=False):
            own[at] = f"x{t}_{at}"
        texts.append(" ".join(own))
    sets = [np.unique(simhash.shingle_hashes(t)) for t in texts]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u in range(n):
        for v in range(u):
            both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            bits = (simhash.majority_bits(simhash.shingle_hashes(texts[u])) ^ simhash.majority_bits(simhash.shingle_hashes(texts[v]))).bit_count() if both < 0.8 * (len(sets[u]) + len(sets[v]) - both) - 1e-9 else 0
            if bits <= 2:
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    assert got == {i: find(i) for i in range(n)}
