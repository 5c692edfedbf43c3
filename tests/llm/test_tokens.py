import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import bfd, bpe, swap_packing, tokens

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    alphabet = "abcdefgh éüñ漢字😀\n\t \x1c\x1d\x85 ​　123²½٣'!?.,-_\x00\r "
    out = ["", "they're I'LL don't 'sx <|endoftext|>"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return out + ["a" * 2000, "ab" * 900 + "a", " " * 700, "é" * 400, "".join(rng.choice("abet") for _ in range(1500))]


def test_ids_equal_the_library(library):
    enc = bpe.Encoder(MULTI)
    for text, raw in zip(texts(), enc.encode_batch(texts())):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()


def test_small_memo_gives_the_same_ids():
    small = bpe.Encoder(MULTI, memo_bytes=500)
    assert list(small.encode_batch(texts()[:60])) == list(bpe.Encoder(MULTI).encode_batch(texts()[:60]))


def test_pair_table_holds_every_pair():
    ranks = bpe.load_ranks(MULTI)
    table = bpe.PairTable(ranks)
    some = random.Random(0).sample(sorted(ranks), 500)
    for token in some:
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                assert table(np.array([a]), np.array([b]))[0] == ranks[token]
    assert table(np.array([ranks[b"q"]]), np.array([ranks[b"\x00"]]))[0] == bpe.NONE


def test_round_trip_query(tricky, library, nothing):
    got = sorted(map(tuple, bpe.round_trip(tricky, MULTI).collect()), key=str)
    want = []
    for r in tricky.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(tricky, MULTI), MULTI)
    assert sorted((bytes(r.decoded).decode() for r in back.collect())) == sorted(r.text or "" for r in tricky.collect())
    assert bpe.round_trip(nothing, MULTI).count() == 0


def test_piecewise_tokenizer_equals_the_library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    for text, raw in zip(texts(), tokens.PieceTokenizer(JSON).encode_batch(texts())):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_cut_is_lossless():
    for n in (0, 1, 7, 8, 9, 16, 17, 100):
        parts = list(tokens.cut(n, 8))
        assert sum(k for _, k in parts) == n and all(k == 8 for _, k in parts[1:])
        assert [s for s, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]


def brute_best_fit(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [c for c in free if c >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(capacity - x)
    return sorted(free)


def test_segment_tree_packs_as_brute_force():
    rng = random.Random(3)
    for capacity in (1, 5, 16, 100):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
            bins = bfd.best_fit_decreasing(lengths, capacity)
            fill = {}
            for b, x in zip(bins, lengths):
                fill[b] = fill.get(b, 0) + x
            assert sorted(capacity - f for f in fill.values()) == brute_best_fit(lengths, capacity)


def test_packed_matrices_hold_every_token_once(tricky, nothing):
    packed = bfd.packed_matrices(tricky, JSON, capacity=64, block_tokens=500).cache()
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    found = {}
    assert packed.select("sequence_id").distinct().count() == packed.count()
    for r in packed.collect():
        ids, pos, cu = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4"), r.cu_seqlens
        assert len(ids) == 64 and cu[0] == 0 and cu[-1] == r.n_tokens and r.crc32 == zlib.crc32(r.ids) and not ids[r.n_tokens :].any()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts)):
            part = ids[cu[k] : cu[k + 1]]
            assert pos[cu[k] : cu[k + 1]].tolist() == list(range(len(part)))
            found.setdefault((d, s), []).append(tuple(part.tolist()))
    want = {}
    for r in tricky.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [50256]
        for s, n in tokens.cut(len(ids), 64):
            want.setdefault((r.doc_id, s), []).append(tuple(ids[s : s + n]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    segments = {}
    for r in bfd.unpack(packed).collect():
        segments.setdefault((r.doc_id, r.start), []).append(tuple(np.frombuffer(r.ids, "<u4").tolist()))
    assert {k: sorted(v) for k, v in segments.items()} == {k: sorted(v) for k, v in want.items()}
    assert bfd.packed_matrices(nothing, JSON).count() == 0


def test_local_search_empties_a_bin():
    # 6+3, 5+4, 2: best fit may leave three bins of ten; exchanges need two.
    lengths, start = np.array([6, 3, 5, 4, 2]), np.array([0, 0, 1, 1, 2])
    bins = swap_packing.local_search(lengths, start, 10)
    fill = np.bincount(bins, weights=lengths)
    assert (fill > 0).sum() == 2 and fill.max() <= 10


def test_local_search_never_worse():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, 120)
        start = np.array(bfd.best_fit_decreasing(lengths.tolist(), 100))
        bins = swap_packing.pack_block(lengths, 100)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and -(-lengths.sum() // 100) <= len(fill) <= start.max() + 1


def test_swap_packing_holds_every_piece(tricky, corpus, nothing):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    for df in (tricky, corpus):
        got = swap_packing.swap_packing(df, JSON, capacity=64, block_pieces=50).collect()
        want = []
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
            want += [(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(tokens.cut(len(ids), 64))]
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        rows = {}
        for r in got:
            rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in rows.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert swap_packing.swap_packing(nothing, JSON).count() == 0


def test_large_ids_beside_null_ids_stay(spark):
    big = [9007199254740993, 9007199254740995, None, 3]
    df = spark.createDataFrame([(i, f"text number {i}") for i in big], "doc_id long, text string").coalesce(1)
    got = swap_packing.swap_packing(df, JSON).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(big, key=str)


def exchanges(lengths, bins, capacity):
    """Every move and exchange of one or two pieces of a bin for none to two of a bin as full, that raises its fill."""
    from itertools import combinations

    fill = {b: sum(n for n, x in zip(lengths, bins) if x == b) for b in set(bins)}
    for a in fill:
        for b in fill:
            if a == b or fill[a] > fill[b] or capacity in (fill[a], fill[b]):
                continue
            own, other = ([i for i, x in enumerate(bins) if x == k] for k in (a, b))
            for m, n in ((1, 0), (1, 1), (2, 1), (1, 2)):
                for out in combinations(own, m):
                    for back in combinations(other, n):
                        gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                        if 0 < gain <= capacity - fill[b]:
                            yield a, b, out, back


def test_local_search_ends_where_nothing_helps():
    rng = np.random.default_rng(5)
    for capacity in (12, 40):
        for _ in range(40):
            lengths = rng.integers(1, capacity, 24)
            start = np.array(bfd.best_fit_decreasing(lengths.tolist(), capacity))
            bins = swap_packing.local_search(lengths, start, capacity)
            least = -(-int(lengths.sum()) // capacity)
            if len(set(bins.tolist())) > least:
                assert not any(exchanges(lengths.tolist(), bins.tolist(), capacity))


def test_local_search_from_a_bad_start():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = rng.integers(1, 30, 40)
        bins = swap_packing.local_search(lengths, np.arange(40), 32)
        assert np.bincount(bins, weights=lengths).max() <= 32
        least = -(-int(lengths.sum()) // 32)
        assert len(set(bins.tolist())) == least or not any(exchanges(lengths.tolist(), bins.tolist(), 32))


def test_words_at_every_edge_equal_the_library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    rng = random.Random(8)
    parts = ["a", "the", " ", " ", "\n", "\n", "\t", "'s", "'", "23", ".", "é", "漢", "\x85", "\x1c", "ing", "aaa", "\r\n", "  ", "\n\n", " ", "word" * 7]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(8000)] + [None]
    for slots, block in ((1 << 16, 1 << 20), (4, 100)):
        tok = tokens.PieceTokenizer(JSON, slots, block)
        for text, raw in zip(some, tok.encode_batch(some), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_every_merge_of_the_file_encodes_to_itself():
    """What the use of ranks for a list of merges rests on."""
    import json

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    with open(JSON, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = tokens._byte_of_letter()
    for token, number in model["vocab"].items():
        raw = bytes(letters.get(c, 0) for c in token)
        if raw.isascii() and raw.removeprefix(b" ").isalpha():
            assert t.encode(raw.decode(), add_special_tokens=False).ids == [number]
