"""Leading eigenvectors of sparse symmetric operators held as edges, for blocks of any size.

A block Krylov method: a block's rows lie in pieces of bounded size with the edges of their rows. A product of the
operator with a few vectors is a grouping by piece, where each piece receives the vectors' rows that its edges need from
the other pieces, at most as many as it has edges; Chebyshev's three-term rule makes a well-conditioned basis of such
products. What one block needs to combine them, the products of the basis' columns with each other, are sums over
rows, as many as the square of the columns, whatever the block's size; each block's small problem is solved in a task,
and its solution joins the pieces again. The products of a cycle are one job of as many shuffles; each cycle is a stored
table, from which the next goes on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Directions of the basis whose share is below this are dropped: they are combinations of the others.
_RANK = 1e-12
#: Rows of a piece, on average.
PIECE = 4096


def _row(key: tuple, columns: pa.Table, found: list[tuple[int, int, dict | np.ndarray, list[float] | None, list[float] | None]]) -> pa.Table:
    """Rows of a piece's table for found (piece, src, body, off, g)."""
    n = len(found)
    blocks = pa.array([key[0].as_py()] * n, columns.schema.field("block").type)
    piece, src, body, off, g = zip(*found)
    lists = [pa.array(x, pa.list_(pa.float64())) for x in (off, g)]
    return pa.table({"block": blocks, "piece": pa.array(piece, pa.int64()), "src": pa.array(src, pa.int64()), "body": pa.array([pickle.dumps(x, 5) for x in body], pa.binary()), "off": lists[0], "g": lists[1]})


def _messages(own: int, state: dict) -> list[tuple]:
    """What the other pieces need of the newest column: the rows with an edge into them, in order of their ids."""
    return [(to, own, state["now"][rows], None, None) for to, rows in state["send"].items()]


def _pieces(edges: DataFrame, start: DataFrame, size: int) -> tuple[DataFrame, str]:
    """The rows of start dealt by hash into pieces of about `size`, each with the edges of its rows: one row of state for
    each piece (its src is -1), and its messages to others. The operator is symmetric, so that what a piece needs of
    another is what that one has edges to."""
    parts = stored(start.groupBy("block").agg(F.ceil(F.count("*") / size).alias("parts")), "parts")
    deal = lambda x: F.pmod(F.xxhash64(x), F.col("parts"))
    rows = start.join(F.broadcast(parts), "block").select("block", deal("i").alias("piece"), "i", "x")
    ties = edges.join(F.broadcast(parts), "block").select("block", deal("i").alias("piece"), deal("j").alias("to"), "i", "j", "a")

    def gather(key: tuple, rows: pa.Table, ties: pa.Table) -> pa.Table:
        rows, own = rows.sort_by("i"), key[1].as_py()
        ids, x = rows.column("i").to_numpy(), rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        i, j, to, a = (ties.column(n).to_numpy() for n in ("i", "j", "to", "a"))
        at, state = np.searchsorted(ids, i), {"ids": ids, "x": x, "now": x, "take": {}, "send": {}}
        for t in np.unique(to).tolist():
            mine = np.flatnonzero(to == t)
            mine = mine[np.argsort(at[mine], kind="stable")]
            rows_at, first = np.unique(at[mine], return_index=True)
            others = ids if t == own else np.unique(j[mine])
            state["take"][t] = (rows_at, first, np.searchsorted(others, j[mine]), a[mine][:, None], len(others))
            if t != own:
                state["send"][t] = rows_at
        return _row(key, rows, [(own, -1, state, None, None), *_messages(own, state)])

    kind = start.schema["block"].dataType.simpleString()
    schema = f"block {kind}, piece long, src long, body binary, off array<double>, g array<double>"
    return rows.groupBy("block", "piece").cogroup(ties.groupBy("block", "piece")).applyInArrow(gather, schema), schema


def _stepped(pieces: DataFrame, schema: str, count: int, last: bool = False) -> DataFrame:
    """One product with the operator in every piece: the next Chebyshev column from the newest one, whose rows have come
    from the other pieces. The first product of a cycle also says how far the wanted columns are off; the last one sums
    up the products of the basis' columns."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, state, sent = key[1].as_py(), None, {}
        for src, body in zip(table.column("src").to_pylist(), table.column("body")):
            if src < 0:
                state = pickle.loads(body.as_buffer())
            else:
                sent[src] = pickle.loads(body.as_buffer())
        sent[own] = now = state["now"]
        y = np.zeros_like(now)
        for t, (rows, first, cols, a, n) in state["take"].items():
            if len(sent.get(t, ())) != n:
                raise ValueError("the operator is not symmetric, or has edges to rows that start does not have")
            y[rows] += np.add.reduceat(a * sent[t][cols], first, axis=0)
        off = g = None
        if "basis" not in state:
            x = state.pop("x")
            state["basis"] = [x, y]
            values = state.pop("values", None)
            if values is not None:
                few = min(count, len(values))
                off = np.append(((y[:, :few] - values[:few] * x[:, :few]) ** 2).sum(axis=0), np.zeros(count - few))
        else:
            y = 2 * y - state["basis"][-2]
            state["basis"].append(y)
        state["now"] = y
        if last:
            b = np.concatenate(state["basis"], axis=1)
            g = (b.T @ b).ravel()
        return _row(key, table, [(own, -1, state, off, g), *([] if last else _messages(own, state))])

    return pieces.groupBy("block", "piece").applyInArrow(run, schema)


def _mixed(pieces: DataFrame, solved: DataFrame, schema: str, width: int, steps: int) -> DataFrame:
    """The pieces with their rows of the solved vectors, and the messages of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(k, 1)])
                own, state = one.column("piece")[0].as_py(), pickle.loads(one.column("body")[0].as_buffer())
                mix = np.array(one.column("mix")[0].as_py())
                state["x"] = state["now"] = np.concatenate(state.pop("basis"), axis=1)[:, : width * steps] @ mix.T
                state["values"] = np.array(one.column("values")[0].as_py())
                yield from _row((one.column("block")[0],), one, [(own, -1, state, None, None), *_messages(own, state)]).to_batches()

    return pieces.select("block", "piece", "body").join(solved, "block").mapInArrow(run, schema)


def _rows(pieces: DataFrame, start: DataFrame) -> DataFrame:
    """(block, i, x) of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                state = pickle.loads(body.as_buffer())
                x = state["basis"][0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(x), batch.schema.field(0).type), pa.array(state["ids"]), lists], names=["block", "i", "x"])

    types = {f.name: f.dataType.simpleString() for f in start.schema}
    return pieces.filter("src < 0").select("block", "body").mapInArrow(run, f"block {types['block']}, i {types['i']}, x array<double>")


def gram(rows: DataFrame) -> DataFrame:
    """(block, at, g): the sums over rows(block, b array) of b_p b_q, at being p * width + q. Tasks sum up their own rows
    of a block first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, own in batch.groupby("block", dropna=False, sort=False):
                b = np.stack(own["b"].to_numpy())
                g = (b.T @ b).ravel()
                yield pd.DataFrame({"block": [block] * len(g), "at": np.arange(len(g)), "g": g})

    kind = rows.schema["block"].dataType.simpleString()
    parts = rows.select("block", "b").sortWithinPartitions("block").mapInPandas(run, f"block {kind}, at long, g double")
    return parts.groupBy("block", "at").agg(F.sum("g").alias("g"))


def _solved(grams: DataFrame, width: int, steps: int) -> DataFrame:
    """(block, values, mix): Ritz values, largest first, and the coefficients of each one's vector over the basis' first
    steps * width columns."""
    n = width * steps
    total = n + width

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(total * total)
        g[pdf["at"].to_numpy()] = pdf["g"].to_numpy()
        g = g.reshape(total, total)
        g = (g + g.T) / 2
        image = np.zeros((total, n))  # A T_k = (T_(k+1) + T_(k-1)) / 2, A T_0 = T_1
        for k in range(steps):
            cols = np.arange(k * width, (k + 1) * width)
            image[cols + width, cols] += 1.0 if k == 0 else 0.5
            if k:
                image[cols - width, cols] += 0.5
        scale = 1 / np.sqrt(np.maximum(np.diag(g)[:n], 1e-300))
        e, v = np.linalg.eigh(g[:n, :n] * scale[:, None] * scale[None])
        keep = e > _RANK * e[-1]
        white = scale[:, None] * v[:, keep] / np.sqrt(e[keep])
        h = white.T @ (g[:n] @ image) @ white
        values, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)[:width]
        mix = white @ y[:, order]
        mixed = np.zeros((width, n))
        mixed[: mix.shape[1]] = mix.T
        return pd.DataFrame({"block": [key[0]], "values": [values[order].tolist()], "mix": [mixed.tolist()]})

    kind = grams.schema["block"].dataType.simpleString()
    return grams.groupBy("block").applyInPandas(run, f"block {kind}, values array<double>, mix array<array<double>>")


def leading(edges: DataFrame, start: DataFrame, count: int, width: int, steps: int = 12, tolerance: float = 1e-6, max_cycles: int = 100, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The `count` largest eigenpairs of each block's operator edges(block, i, j, a), symmetric and with eigenvalues in
    [-1, 1]: rows (block, i, x) with orthonormal columns, best first, and (block, values, residual), the largest residual
    of the wanted pairs, summed up from the rows.

    start(block, i, x) has `width` columns, and a row for each end of an edge; `size` is the rows of a piece. Cycles of `steps` products run until all wanted residuals are below
    `tolerance` (the basis allows about 1e-7; values are right to the square of it); they are more
    where eigenvalues lie close together. A block of fewer rows than `count` has as many values
    as rows. An empty table gives no rows.
    """
    start = stored(start, "start")
    pieces, schema = _pieces(stored(edges, "edges"), start, size)
    for cycle in range(max_cycles):
        for step in range(2 if cycle else 1, steps + 1):
            pieces = _stepped(pieces, schema, count, step == steps)
        pieces = stored(pieces, "krylov")
        sums = pieces.filter("g IS NOT NULL").select("block", F.posexplode("g").alias("at", "g"))
        solved = stored(_solved(sums.groupBy("block", F.col("at").cast("long").alias("at")).agg(F.sum("g").alias("g")), width, steps), "ritz")
        pieces = stored(_stepped(_mixed(pieces, solved, schema, width, steps), schema, count), "vectors")
        squares = [F.sum(F.col("off")[c]).alias(f"r{c}") for c in range(count)]
        residuals = stored(pieces.filter("off IS NOT NULL").groupBy("block").agg(*squares).select("block", F.sqrt(F.greatest(F.lit(0.0), *[f"r{c}" for c in range(count)])).alias("residual")), "residuals")
        worst = residuals.agg(F.max("residual")).first()[0]
        if worst is None or worst <= tolerance:
            return _rows(pieces, start), solved.select("block", "values").join(residuals, "block")
    raise RuntimeError(f"residuals are still up to {worst:g} after {max_cycles} cycles")


def laplacian_eigen(aff: DataFrame, count: int, guard: int = 4, size: int = PIECE) -> DataFrame:
    """Leading eigenpairs of each block's normalised Laplacian: (block, l, value, i, phi), phi scaled to unit mean square and
    signed at its largest place, the constant one first. aff(block, i, j, a) is symmetric."""
    width = count + guard
    aff = stored(aff.select("block", "i", "j", "a"), "laplacian")
    degree = stored(aff.groupBy("block", "i").agg(F.sum("a").alias("d")), "degrees")
    at = degree.select("block", F.col("i").alias("j"), F.col("d").alias("dj"))
    edges = aff.join(degree, ["block", "i"]).join(at, ["block", "j"]).select("block", "i", "j", (F.col("a") / F.sqrt(F.col("d") * F.col("dj"))).alias("a"))
    noise = [F.xxhash64("i", F.lit(c)) / F.lit(2.0**63) for c in range(1, width)]
    x, values = leading(edges, degree.select("block", "i", F.array(F.sqrt("d"), *noise).alias("x")), count, width, size=size)
    long = x.join(degree, ["block", "i"]).join(F.broadcast(values), "block").select("block", "i", F.posexplode(F.slice(F.transform("x", lambda y: y / F.sqrt("d")), 1, F.least(F.lit(count), F.size("values")))).alias("l", "phi"), "values")
    long = long.withColumn("value", F.greatest(1 - F.element_at("values", F.col("l") + 1), F.lit(0.0))).drop("values")
    norm = long.groupBy("block", "l").agg(F.sqrt(F.avg(F.col("phi") * F.col("phi"))).alias("norm"), F.max_by("phi", F.struct(F.abs("phi"), -F.col("i"))).alias("big"))
    return stored(long.join(norm, ["block", "l"]).select("block", "l", "value", "i", (F.col("phi") * F.signum("big") / F.col("norm")).alias("phi")), "eigen")
