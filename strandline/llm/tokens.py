"""Token ids by a tokenizer file: words are looked up for whole batches at once and merged only when new.

A byte-level tokenizer splits a text by the pattern of `bpe` before it merges. No match of that pattern reaches over a
space that stands alone between two other characters, nor over a line end that does; such a space begins the next
match, and such a line end is a match of its own. So a text's ids are those of its words in turn, each with the space
or line end before it. A text with other white space at the edge of a word (tabs, runs of spaces, blank lines with
spaces) is encoded as a whole.

Merging runs on the file's own merges, as ranks in the faster of the two libraries. Merging by ranks and by a list of
merges agree where every token of the list encodes to itself: what lies inside a token's span is merged in the same
order in any context. Files of another kind than a plain byte-level BPE go through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from .bpe import PATTERN

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: A word of up to 23 bytes is a key of three 64-bit numbers, its length in the last byte.
_KEY = 24
_MOST_IDS = 8
_SPACE, _LINE = 0x20, 0x0A


def _packed(ids: list[int]) -> bytes:
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


def _byte_of_letter() -> dict[str, int]:
    """Byte-level files write a printable byte as itself and the others as letters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _plain(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE that only splits by the pattern and merges."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = all(t.get("special") for t in spec.get("added_tokens") or [])
    return model.get("type", "BPE") == "BPE" and not odd and splits and added and not spec.get("normalizer")


def _by_ranks(spec: dict) -> Callable[[str], bytes]:
    """Encodes a text by the merges of a plain file."""
    letters, vocab = _byte_of_letter(), spec["model"]["vocab"]
    raw = lambda token: bytes(letters[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    single = sorted((c for c in letters if c in vocab), key=vocab.get)
    if len(single) < 256:
        raise ValueError("the vocabulary lacks single bytes")
    order = [*single, *dict.fromkeys(a + b for a, b in merges)]
    ids = np.array([vocab[t] for t in order], "<u4")
    core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={raw(t): k for k, t in enumerate(order)}, special_tokens={})._core_bpe
    whole, none = core.encode_to_tiktoken_buffer, set()
    return lambda text: ids[np.frombuffer(whole(text, none), np.uint32)].tobytes() if text else b""


def _ragged(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices offsets[i], ..., offsets[i] + counts[i] - 1 of all i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - counts), counts)


class _Table:
    """Ids by word, one word a slot: a new word takes the slot of the one that held it, so the size never changes."""

    def __init__(self, slots: int):
        self.shift = np.uint64(64 - (slots - 1).bit_length())
        self.keys = np.zeros((slots, 3), np.uint64)  # a key's last byte is its length, never 0
        self.ids = np.zeros((slots, _MOST_IDS), "<u4")
        self.n = np.zeros(slots, np.int8)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] ^ (keys[:, 0] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ keys[:, 1] ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ keys[:, 2] ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (h >> self.shift).astype(np.int64)


#: For each length of a word the bits of its key's three numbers that hold the word.
_MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(_KEY)], np.uint64)


class PieceTokenizer:
    """Ids of whole texts by a tokenizer file, without special tokens, whose strings count as ordinary text.

    Words of up to 23 bytes and 8 ids are remembered in `slots` (a power of two) places of 57 bytes each.
    """

    def __init__(self, path: str, slots: int = 1 << 19, block: int = 1 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain, self.block = _plain(spec), block
        if self.plain:
            self.whole = _by_ranks(spec)
            self.line_end = np.frombuffer(self.whole("\n"), "<u4")
            self.table = _Table(slots)
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.whole = lambda text: _packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of words, all encoded as lines of one text; -1 where a word's ids depend on what surrounds it."""
        counts, lines, at = np.full(len(words), -1, np.int64), [], []
        lead = np.zeros(len(words), bool)
        for i, w in enumerate(words):
            text = w.decode("utf-8", "replace")
            bare = text[1:] if text[0] in " \n" else text
            if bare and bare == bare.strip():
                lead[i] = text[0] == "\n"
                lines.append(bare if lead[i] else text)
                at.append(i)
            elif text == "\n":
                counts[i] = 0
                lead[i] = True
        ids = np.frombuffer(self.whole("\n".join(lines)), "<u4")
        stops = np.flatnonzero(ids == self.line_end[0]) if lines else np.zeros(0, np.int64)
        if len(stops) + 1 != len(lines) and lines:
            raise ValueError("a line end is not an id of its own")
        counts[at] = np.diff(np.r_[-1, stops, len(ids)])[: len(lines)] - 1
        inner = np.ones(len(ids), bool)
        inner[stops] = False
        ids = ids[inner]
        # The line end of the words that begin with one goes before their ids.
        starts = np.cumsum(np.maximum(counts, 0)) - np.maximum(counts, 0)
        return counts + lead, np.insert(ids, starts[lead], self.line_end[0])

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts data[bounds[i]:bounds[i + 1]]: all their ids, where each text's begin, and which are unsound."""
        edge = (data == _SPACE) | (data == _LINE)
        first = bounds[:-1][np.diff(bounds) > 0]
        edge[first] = True
        starts = np.flatnonzero(edge)
        lengths = np.diff(np.append(starts, len(data)))
        table, words = self.table, len(starts)
        padded = np.concatenate([data, np.zeros(_KEY, np.uint8)])
        eight = np.ndarray((len(data) + _KEY - 7,), "<u8", padded, strides=(1,))
        short = np.minimum(lengths, _KEY - 1)
        keys = np.empty((words, 3), np.uint64)
        for k in range(3):
            keys[:, k] = eight[starts + 8 * k] & _MASKS[short, k]
        keys[:, 2] |= short.astype(np.uint64) << np.uint64(56)
        slot = table.slots(keys)
        known = (table.keys[slot] == keys).all(axis=1) & (lengths < _KEY)
        counts = np.where(known, table.n[slot], 0).astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a : a + n] for a, n in zip(starts[new].tolist(), lengths[new].tolist())]
            place = {w: i for i, w in enumerate(dict.fromkeys(texts))}
            n_ids, ids = self._merged(list(place))
            which = np.fromiter(map(place.__getitem__, texts), np.int64, len(texts))
            counts[new] = n_ids[which]
        bad = counts < 0
        alone = (lengths == 1) & (data[starts] == _LINE)
        twice = np.flatnonzero(alone[:-1] & alone[1:])
        twice = twice[~np.isin(starts[twice + 1], first)] if len(twice) else twice  # within one text
        bad[twice] = True
        np.maximum(counts, 0, out=counts)
        regular = np.where(known, counts, 0)
        rows = table.ids[slot]
        flat = rows[np.arange(_MOST_IDS)[None, :] < regular[:, None]]
        if len(new):
            out = np.empty(int(counts.sum()), "<u4")
            of_known = np.repeat(known, counts)
            out[of_known] = flat
            positive = np.maximum(n_ids, 0)
            begin = np.cumsum(positive) - positive
            out[~of_known] = ids[_ragged(begin[which], positive[which])]
            keep = (lengths[new] < _KEY) & (n_ids[which] <= _MOST_IDS)
            s, w = slot[new[keep]], which[keep]
            table.keys[s], table.n[s] = keys[new[keep]], n_ids[w]  # of several for one slot the last stays in all arrays
            wide = np.minimum(begin[w][:, None] + np.arange(_MOST_IDS)[None, :], max(len(ids) - 1, 0))
            table.ids[s] = ids[wide] if len(ids) else 0
            flat = out
        places = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(starts, bounds)
        unsound = np.zeros(len(bounds) - 1, bool)
        unsound[np.searchsorted(bounds, starts[bad], side="right") - 1] = True
        return flat, places[at], unsound

    def encode_batch(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.plain:
            yield from (self.whole(t) if t else b"" for t in texts.to_pylist())
            return
        full = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
        data = np.frombuffer(full.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(full):
            hi = max(int(np.searchsorted(offsets, offsets[lo] + self.block, side="right")) - 1, lo + 1)
            hi = min(hi, len(full))
            a, b = int(offsets[lo]), int(offsets[hi])
            if b - a > 8 * self.block:  # one very long text
                yield self.whole(full[lo].as_py())
            elif b == a:
                yield from [b""] * (hi - lo)
            else:
                ids, at, unsound = self._block(data[a:b], offsets[lo : hi + 1] - a)
                raw, at = ids.tobytes(), (4 * at).tolist()
                for k in range(hi - lo):
                    yield self.whole(full[lo + k].as_py()) if unsound[k] else raw[at[k] : at[k + 1]]
            lo = hi


_tokenizers: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` tokens: only the first may be shorter than capacity."""
    start = 0
    length = total % capacity or min(total, capacity)
    while start < total:
        yield start, length
        start += length
        length = capacity
