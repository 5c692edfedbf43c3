"""Packed id matrices: best-fit-decreasing packing with a segment tree over free capacities.

Each map task encodes its documents, gathers a bounded block of pieces and packs the block; nothing is shuffled, so
a corpus of any size packs at the speed of its scan, and a block's half-filled last sequences are the only loss.
A document with more tokens than the capacity is cut losslessly into full pieces behind a shorter first one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import cut, piece_tokenizer


class FreeCapacities:
    """A segment tree over capacities 0..size: finds the smallest capacity >= need that some open bin has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, bin_no: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_no)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of a tightest bin that holds `need`, removed from the tree; None if there is none."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # climb to a right sibling that has bins
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length (1..capacity); ties go by position."""
    tree, bins, used = FreeCapacities(capacity), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            got = capacity, used
            used += 1
        bins[i] = got[1]
        if got[0] > lengths[i]:
            tree.put(got[0] - lengths[i], got[1])
    return bins


_SCHEMA = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, starts array<long>, crc32 long"


def _pack(path: str, capacity: int, end_id: int | None, pad_id: int, block_tokens: int, id_type: pa.DataType):
    names = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts", "crc32"]

    def rows(block: list, base: int) -> pa.RecordBatch:
        bins = best_fit_decreasing([len(x[2]) for x in block], capacity)
        members: dict[int, list[int]] = {}
        for i, b in enumerate(bins):
            members.setdefault(b, []).append(i)
        out: dict[str, list] = {n: [] for n in names}
        for b in sorted(members):
            own = [block[i] for i in members[b]]
            row, positions, cu = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4"), [0]
            for _, _, ids in own:
                row[cu[-1] : cu[-1] + len(ids)] = ids
                positions[cu[-1] : cu[-1] + len(ids)] = np.arange(len(ids))
                cu.append(cu[-1] + len(ids))
            raw = row.tobytes()
            for n, v in zip(names, (base + b, cu[-1], raw, cu, positions.tobytes(), [x[0] for x in own], [x[1] for x in own], zlib.crc32(raw))):
                out[n].append(v)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = piece_tokenizer(path)
        part = TaskContext.get().partitionId() << 40
        block, held, used = [], 0, 0
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), tok.encode_batch(b.column(1))):
                ids = np.frombuffer(raw, "<u4")
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                for start, n in cut(len(ids), capacity):
                    block.append((key, start, ids[start : start + n]))
                held += len(ids)
                if held >= block_tokens:
                    done = rows(block, part + used)
                    used += done.num_rows
                    block, held = [], 0
                    yield done
        if block:
            yield rows(block, part + used)

    return run


def packed_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 50256, pad_id: int = 0, block_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence.

    sequence_id (unique), n_tokens (without padding), ids (the matrix row: `capacity` little-endian unsigned 32-bit
    ids), cu_seqlens (cumulative segment lengths from 0), position_ids (as ids; they restart at each segment and are
    0 in the padding), doc_ids and starts (document and first token of each segment), crc32 of ids.

    A null or empty text is its end id alone, and gives nothing where end_id is null. Repeated rows are packed as
    often as they come; a null id stays null. Other columns are ignored; an empty table gives no rows. A recomputed
    task gives the same rows, as all depends on its own input split.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[id_col].dataType
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(_pack(tokenizer_path, capacity, end_id, pad_id, block_tokens, to_arrow_type(field)), _SCHEMA.format(kind=field.simpleString()))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet files of binary rows, in which a row group is a slab of the id matrix."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary) of every segment of packed sequences: the inverse of packing."""
    seg = packed.select("ids", F.posexplode("cu_seqlens").alias("k", "lo"), "cu_seqlens", "doc_ids", "starts").filter(F.col("k") < F.size("doc_ids"))
    n = F.element_at("cu_seqlens", F.col("k") + 2) - F.col("lo")
    return seg.select(F.element_at("doc_ids", F.col("k") + 1).alias("doc_id"), F.element_at("starts", F.col("k") + 1).alias("start"), F.substring(F.col("ids"), F.col("lo") * 4 + 1, n * 4).alias("ids"))
