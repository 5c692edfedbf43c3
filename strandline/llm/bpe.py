"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Every different piece of a batch (a match of the pattern that the memo doesn't hold yet) becomes a row of a padded
matrix of byte ids, together with pieces of about its length. In each round every row looks up the rank of all its
adjacent pairs in an open-addressing hash table, merges its leftmost pair of minimum rank and is compacted; rows
without a mergeable pair are finished and leave the matrix. A memo of bounded size keeps the ids of pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int32).max


def _latin_class(kind: str) -> str:
    """The characters below U+0100 of a class of the pattern, for a set of the standard library's expressions."""
    is_one = regex.compile(kind).fullmatch
    return "".join(f"\\x{c:02x}" for c in range(256) if is_one(chr(c)))


class Splitter:
    """findall of PATTERN. Texts of characters below U+0100 alone take the standard library's faster engine, with the
    classes written out and the words first, which changes nothing as no other branch begins like a word."""

    def __init__(self):
        letters, numbers, spaces = _latin_class(r"\p{L}"), _latin_class(r"\p{N}"), _latin_class(r"\s")
        latin = rf" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
        self.latin, self.full = re.compile(latin).findall, regex.compile(PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full(text)
        return self.latin(text)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open addressing from a pair of token ids to the id of their concatenation, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        values = np.array(to, np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.values[at[todo]] == NONE
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            won = todo[free][self.keys[at[todo[free]]] == keys[todo[free]]]
            self.values[at[won]] = values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        flat = keys.ravel()
        at = self._slot(flat)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != flat) & (out != NONE))
        found = self.keys[at] == flat
        out[~found] = NONE
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            slot = at[todo]
            hit, end = self.keys[slot] == flat[todo], self.values[slot] == NONE
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & ~end]
        return out.reshape(keys.shape)


def _merge_bucket(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> list[bytes]:
    """ids: one row for each piece, padded; the merged ids of each as little-endian unsigned 32-bit integers."""
    out = [b""] * len(ids)
    rows = np.arange(len(ids))
    while len(rows):
        width = int(lengths.max())
        ids = ids[:, :width]
        column = np.arange(max(width - 1, 1))[None, :]
        ranks = pairs(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 1), NONE, np.int32)
        ranks[column + 1 >= lengths[:, None]] = NONE
        at = ranks.argmin(axis=1)  # the leftmost of the minimum
        best = ranks[np.arange(len(rows)), at]
        done = best == NONE
        if done.any():
            raw = ids[done].astype("<u4").tobytes()
            for k, (r, n) in enumerate(zip(rows[done].tolist(), lengths[done].tolist())):
                out[r] = raw[4 * width * k : 4 * (width * k + n)]
            live = ~done
            ids, lengths, rows, at, best = ids[live], lengths[live], rows[live], at[live], best[live]
        if len(rows):
            ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])  # compaction over the merged neighbour
            ids[np.arange(len(rows)), at] = best
            lengths = lengths - 1
    return out


def _merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One very long piece. A round merges every occurrence of the minimum rank at once where that gives what merging
    the leftmost again and again gives: where no pair that arises on the way ranks as low; else only the leftmost."""
    while len(ids) > 1:
        ranks = pairs(ids[:-1], ids[1:])
        best = ranks.min()
        if best == NONE:
            break
        where = np.flatnonzero(ranks == best)
        starts = np.r_[True, np.diff(where) > 1]  # of a run of overlapping pairs every other one merges
        run = np.maximum.accumulate(np.where(starts, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - run) % 2 == 0]
        merged = ids.copy()
        merged[where] = best
        after = where[where + 2 < len(ids)]
        keep = np.ones(len(ids), bool)
        keep[where + 1] = False
        to_right = pairs(np.full(len(after), best, ids.dtype), ids[after + 2])
        packed = merged[keep]
        at = np.flatnonzero(packed == best)
        at = at[at > 0]
        to_left = pairs(packed[at - 1], packed[at])
        if min(to_right.min(initial=NONE), to_left.min(initial=NONE)) > best:
            ids = packed
        else:
            ids = np.delete(ids, where[0] + 1)
            ids[where[0]] = best
    return ids


class Encoder:
    """Text to ids by a rank file, as a reference encoder of such files does without special tokens."""

    LONG = 256
    #: What an entry of the memo takes besides its text and ids.
    ENTRY = 160

    def __init__(self, path: str, memo_bytes: int = 256 << 20):
        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.split = Splitter()
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes, self.held = memo_bytes, 0

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of pieces, as little-endian unsigned 32-bit integers, into the memo."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memo[p] = whole.to_bytes(4, "little")
            elif len(raw) > self.LONG:
                ids = _merge_long(self.byte_ids[np.frombuffer(raw, np.uint8)], self.pairs)
                self.memo[p] = ids.astype("<u4").tobytes()
            else:
                buckets.setdefault((len(raw) + 7) // 8, []).append((p, raw))
        for width, rows in buckets.items():
            for lo in range(0, len(rows), 4096):
                part = rows[lo : lo + 4096]
                lengths = np.array([len(r) for _, r in part])
                matrix = np.zeros((len(part), 8 * width), np.int32)
                matrix[np.arange(8 * width)[None, :] < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join([r for _, r in part]), np.uint8)]
                self.memo.update(zip([p for p, _ in part], _merge_bucket(matrix, lengths, self.pairs)))

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty. The memo is emptied when it
        holds more than its bytes; pieces of more than LONG bytes are forgotten after their 256 texts."""
        for lo in range(0, len(texts), 256):
            split = [self.split(t or "") for t in texts[lo : lo + 256]]
            if self.held > self.memo_bytes:
                self.memo.clear()
                self.held = 0
            memo = self.memo
            new = {p for pieces in split for p in pieces if p not in memo}
            if new:
                self._learn(list(new))
            for pieces in split:
                yield b"".join([memo[p] for p in pieces])
            for p in new:
                if len(p) > self.LONG or len(memo[p]) > 4 * self.LONG:
                    del memo[p]
                else:
                    self.held += self.ENTRY + len(p) + len(memo[p])

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for lo in range(0, b.num_rows, 256):
                for raw in enc.encode_batch(b.column(1).slice(lo, 256).to_pylist()):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in enc.encode_batch(b.column(1).slice(lo, 256).to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            raw = [enc.decode(np.asarray(x.values.to_numpy(zero_copy_only=False))) if x.is_valid else b"" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "decoded"])

    return run


def _two(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; a null or empty text gives no ids. ranks_path must exist on every executor."""
    two, kind = _two(docs, id_col, text_col)
    return two.mapInArrow(_ids(ranks_path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes of ids; null ids give no bytes."""
    two, kind = _two(rows, id_col, ids_col)
    return two.mapInArrow(_texts(ranks_path), f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids: id, n_tokens, ids_sha256, decoded_sha256, one row per row of docs.

    Null counts as empty. Repeated rows give repeated results. Other columns are ignored. A map-only plan.
    """
    two, kind = _two(docs, id_col, text_col)
    return two.mapInArrow(_digests(ranks_path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
