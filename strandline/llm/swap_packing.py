"""Packing documents into sequences by swap-based local search.

Pieces are dealt by hash into blocks of bounded size, so no key, source or long document gathers in one task. In
each block a best-fit-decreasing start is improved: the emptiest underfull bin gives up documents by moves,
one-for-one, two-for-one and one-for-two exchanges with fuller underfull bins, each of which raises the sum of
squared fills, until it is empty or nothing helps. A block stops at its lower bound, ceil(tokens / capacity).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bfd import best_fit_decreasing
from .common import checkpointed, small_batches
from .tokens import cut, piece_tokenizer


def _choices(lengths: np.ndarray, own: np.ndarray, capacity: int) -> tuple[np.ndarray, dict[int, list[int]], np.ndarray, dict[int, list[int]]]:
    """What the pieces `own` of one bin can give, singly and in pairs: for each size the largest total within it, and
    the pieces of each total. Pieces of equal length are alike, so a bin has few lengths and all pairs are tried."""
    of_length: dict[int, list[int]] = {}
    for i in own.tolist():
        of_length.setdefault(int(lengths[i]), []).append(i)
    one = {n: some[:1] for n, some in of_length.items()}
    two: dict[int, list[int]] = {}
    known = sorted(of_length)
    for k, n in enumerate(known):
        if len(of_length[n]) > 1:
            two.setdefault(2 * n, of_length[n][:2])
        for m in known[k + 1 :]:
            two.setdefault(n + m, [of_length[n][0], of_length[m][0]])
    within = []
    for some in (one, two):
        least = np.zeros(capacity + 1, np.int64)
        totals = np.array([t for t in some if t <= capacity], np.int64)
        least[totals] = totals
        within.append(np.maximum.accumulate(least))
    return within[0], one, within[1], two


def _pairs(lengths: np.ndarray, bins: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of `pieces` that lie in one bin, but for one of each two lengths only."""
    order = pieces[np.lexsort((lengths[pieces], bins[pieces]))]
    b, n = bins[order], lengths[order]
    same = (b[1:] == b[:-1]) & (n[1:] == n[:-1])
    third = np.r_[False, False, same[1:] & same[:-1]] if len(order) > 2 else np.zeros(len(order), bool)
    order = order[~third]
    b, first, second, step = bins[order], [], [], 1
    while step < len(order) and (hit := np.flatnonzero(b[step:] == b[:-step])).size:
        first.append(order[hit])
        second.append(order[hit + step])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(first or [none]), np.concatenate(second or [none])


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, max_steps: int | None = None) -> np.ndarray:
    """bins (of each piece) improved; never more bins than before. Every exchange raises the sum of squared fills, so
    the search ends by itself, where no move and no exchange of the four kinds is left or at the lower bound."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = math.ceil(lengths.sum() / capacity)
    stuck = np.zeros(len(fill), bool)
    used, steps, pairs = np.count_nonzero(fill), 0, None
    while used > least and (max_steps is None or steps < max_steps):
        open_ = (fill > 0) & (fill < capacity)
        if not (open_ & ~stuck).any():
            break
        a = int(np.where(open_ & ~stuck, fill, capacity + 1).argmin())
        own = np.flatnonzero(bins == a)
        targets = np.flatnonzero(open_ & (fill >= fill[a]))
        targets = targets[targets != a]
        out = back = None
        if len(targets):
            within_one, one, within_two, two = _choices(lengths, own, capacity)
            room = capacity - fill[targets]
            n = int(within_one[room.max()])
            if n:  # a move, to the tightest bin
                fits = np.flatnonzero(room >= n)
                out, back, b = one[n], [], int(targets[fits[room[fits].argmin()]])
            else:
                ok = np.zeros(len(fill), bool)
                ok[targets] = True
                rest = np.flatnonzero(ok[bins])
                size = lengths[rest]
                reach = size + capacity - fill[bins[rest]]
                best = 0
                for within, some in ((within_one, one), (within_two, two)):  # one or two of this bin for one of another
                    gain = within[reach] - size
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best = int(gain[k])
                        out, back, b = some[int(within[reach[k]])], [int(rest[k])], int(bins[rest[k]])
                if not best:  # one of this bin for two of another
                    if pairs is None:
                        pairs = _pairs(lengths, bins, np.flatnonzero(open_[bins]))
                    x, y = pairs
                    total = lengths[x] + lengths[y]
                    gain = np.where(ok[bins[x]], within_one[np.minimum(total + capacity - fill[bins[x]], capacity)] - total, 0)
                    if len(gain) and gain.max() > 0:
                        k = int(gain.argmax())
                        out, back, b = one[int(total[k] + gain[k])], [int(x[k]), int(y[k])], int(bins[x[k]])
        if out is None:
            stuck[a] = True
            continue
        moved = int(lengths[out].sum() - lengths[back].sum())
        bins[out], bins[back] = b, a
        fill[a] -= moved
        fill[b] += moved
        used -= fill[a] == 0
        stuck[:] = False
        steps, pairs = steps + 1, None
    return bins


def pack_block(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, numbered from 0 without gaps."""
    start = np.array(best_fit_decreasing(lengths.tolist(), capacity), np.int64)
    return np.unique(local_search(lengths, start, capacity), return_inverse=True)[1]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = piece_tokenizer(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            row, piece, starts, lengths, crc = [], [], [], [], []

            def some() -> pa.RecordBatch:
                made = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                return pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids_crc32"])

            for i, raw in enumerate(tok.encode_batch(b.column(1))):
                raw += end
                for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    starts.append(start)
                    lengths.append(n)
                    crc.append(zlib.crc32(raw[4 * start : 4 * (start + n)]))
                if len(row) >= 65_536:
                    yield some()
                    for x in (row, piece, starts, lengths, crc):
                        x.clear()
            yield some()

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end id; see `tokens.cut`."""
    kind = docs.schema[id_col].dataType.simpleString()
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def swap_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, block_pieces: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed as often as they come, though rows that agree
    in all columns are told apart by their sequence and offset only. Other columns are ignored; an empty table gives
    no rows. block_pieces bounds what one task packs at a time; every piece is packed.
    """
    with small_batches(docs.sparkSession):
        found = checkpointed(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    blocks = max(1, math.ceil(found.count() / block_pieces))
    dealt = found.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))
    schema = found.schema.add("sequence_id", "long").add("offset", "long")

    def pack(block: pa.Table) -> pa.Table:
        # The order of arrival differs between attempts of a task; this one doesn't. Ids are only taken along.
        ties = block.set_column(block.schema.get_field_index("doc_id"), "doc_id", block["doc_id"].cast(pa.string()))
        block = block.take(pc.sort_indices(ties, sort_keys=[(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "piece")]))
        lengths = block["length"].to_numpy()
        place = pack_block(lengths, capacity)
        order = np.argsort(place, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        heads = np.r_[True, np.diff(place[order]) > 0]
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(heads, before, 0))
        number = place + (block["block"][0].as_py() << 32)
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("block").applyInArrow(pack, schema)
