"""Exact nearest neighbours within labels of any size, by pivots.

Some vectors of a label serve as pivots, about the root of their number; each vector lies in the cell of its nearest
pivot. Its neighbours within the cell give it a radius that holds its true neighbours; where the cell is too small for
that, its distances to the pivots and the cells' smallest distances do. A vector is then sent only to those cells that
its ball can meet, by the triangle inequality: against the plane between the two pivots, and against the range of
distances that the cell's members have from their pivot.

Cells lie in tiles of about `TILE` vectors, a larger cell in several of its own. What meets in a task is a tile and as
many visitors; there distances are matrix products, which select, and the selected ones are counted again term by term,
so that the products' rounding decides nothing. Where distances are all alike every cell is met, as in any exact search.

Equal vectors are one vector with its smallest ids, as many as can matter, so that copies cost no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: What rounding may take from a bound, relative to the distances in it.
_SLACK = 1e-9
#: Vectors of a tile, and visitors that meet it at once, on average.
TILE = 4096
#: Rows of a matrix of distances in a task.
_ROWS = 256


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


@dataclass(frozen=True)
class Search:
    """The tables of a search: members(block, i, u) of each different vector u, its neighbours top(block, u, j, d), and
    the pairs of different vectors that were compared, within cells and between them."""

    members: DataFrame
    top: DataFrame
    near: DataFrame
    far: DataFrame


def _smallest(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts each task's rows down to n before it sends them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", rank).filter(F.col("place") <= n)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, term by term in order, as `distance` counts them."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        gap = x[:, c] - y[:, c]
        total += gap * gap
    return np.sqrt(total)


class _Products:
    """Squared distances of the rows of x and y as matrix products, right up to `error`."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        at = y.mean(axis=0) if len(y) else 0.0
        self.x, self.y = x - at, y - at
        self.xx, self.yy = (self.x**2).sum(axis=1), (self.y**2).sum(axis=1)
        self.error = 1e-14 * (x.shape[1] + 8) * (self.xx.max(initial=0.0) + self.yy.max(initial=0.0))

    def __call__(self, rows, cols) -> np.ndarray:
        d = self.x[rows] @ self.y[cols].T
        d *= -2
        d += self.xx[rows][:, None]
        d += self.yy[cols]
        return np.maximum(d, 0, out=d)


def _first(d: np.ndarray, n: int, error: float, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of what may be among the n smallest of each row and within its limit; infinite ones are no pairs."""
    if d.shape[1] > n:
        limit = np.minimum(limit, np.partition(d, n - 1, axis=1)[:, n - 1] + 2 * error)
    return np.nonzero((d <= limit[:, None]) & (d < np.inf))


def _listed(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _found(own: pa.Table, rows: np.ndarray, others: pa.Table, cols: np.ndarray, d: np.ndarray) -> pa.Table:
    """(block, u, j, d): the ids of others at the places cols, for own at the places rows."""
    ids = others.column("ids").combine_chunks().take(pa.array(cols))
    each = np.repeat(np.arange(len(rows)), ids.value_lengths().to_numpy(zero_copy_only=False))
    at = pa.array(rows[each])
    return pa.table({"block": own.column("block").take(at), "u": own.column("u").take(at), "j": ids.flatten(), "d": d[each]})


def search(vectors: DataFrame, k: int, cell: int | None = None, tile: int = TILE) -> Search:
    """Neighbours of every different vector(block, id, v), k + 1 ids of them at most, its own ids included. Cells have
    about the root of the label's vectors, or `cell` if that is given. A row without a vector has no neighbours."""
    most = k + 1
    base = vectors.filter("v IS NOT NULL").select("block", F.col("id").alias("i"), "v")
    few = _smallest(base, ["block", "v"], ["i"], most)
    unique = stored(few.groupBy("block", "v").agg(F.array_sort(F.collect_list("i")).alias("ids")).withColumn("u", F.col("ids")[0]), "vectors")
    members = base.join(unique.select("block", "v", "u"), ["block", "v"]).select("block", "i", "u")
    types = {f.name: f.dataType.simpleString() for f in unique.schema}
    row = f"block {types['block']}, u {types['u']}, v {types['v']}, ids {types['ids']}"
    pairs = f"block {types['block']}, u {types['u']}, j {types['u']}, d double"
    # Pivots: those whose hash falls in one of so many classes, and the one of the smallest hash, so that there is one.
    h = F.xxhash64("u", "v")
    sizes = stored(unique.groupBy("block").agg(F.count("*").alias("n"), F.min(h).alias("low")).withColumn("parts", F.ceil(F.col("n") / tile)), "sizes")
    wide = F.lit(cell) if cell else F.greatest(F.lit(64), F.ceil(F.sqrt("n")))
    chosen = unique.withColumn("h", h).join(sizes, "block").filter((F.pmod("h", wide) == 0) | (F.col("h") == F.col("low")))
    pivots = stored(chosen.select("block", F.col("u").alias("p"), F.col("v").alias("pv"), "parts"), "pivots")
    part = F.pmod(F.xxhash64("u"), F.col("parts")).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")

    def assign(key: tuple, rows: pa.Table, heads: pa.Table) -> pa.Table:
        x, y, p = _matrix(rows, "v"), _matrix(heads, "pv"), heads.column("p").to_numpy()
        product, own, dp = _Products(x, y), np.zeros(len(x), np.int64), np.zeros(len(x))
        for lo in range(0, len(x), _ROWS):
            some = slice(lo, lo + _ROWS)
            d = product(some, slice(None))
            r, c = _first(d, 1, product.error, np.full(len(d), np.inf))
            e = _exact(x[lo + r], y[c])
            order = np.lexsort((p[c], e, r))
            r, c, e = r[order], c[order], e[order]
            first = np.concatenate([[True], r[1:] != r[:-1]])
            own[some], dp[some] = c[first], e[first]
        return pa.table({**{n: rows.column(n) for n in ("block", "u", "v", "ids")}, "p": heads.column("p").take(pa.array(own)), "dp": dp})

    left = unique.join(F.broadcast(sizes), "block").select("block", part, "u", "v", "ids").groupBy("block", "part")
    right = pivots.select("block", every, "p", "pv").groupBy("block", "part")
    celled = stored(left.cogroup(right).applyInArrow(assign, f"{row}, p {types['u']}, dp double"), "cells")
    # A cell of more than a tile falls into several; a place in the tiles is dealt by hash.
    shares = celled.groupBy("block", "p").agg(F.ceil(F.count("*") / tile).alias("shares"))
    dealt = celled.join(shares, ["block", "p"]).withColumn("share", F.pmod(F.xxhash64("u"), F.col("shares"))).join(F.broadcast(sizes.select("block", "parts")), "block")
    placed = F.pmod(F.xxhash64("p", "share"), F.col("parts")).alias("tile")
    cells = stored(dealt.select("block", "u", "v", "ids", "p", "dp", "share", "shares", "parts", placed), "tiles")

    def within(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("p", "ascending"), ("share", "ascending")])
        x, p, share = _matrix(rows, "v"), rows.column("p").to_numpy(), rows.column("share").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (share[1:] != share[:-1]), [True]]))
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            product = _Products(x[a:b], x[a:b])
            for lo in range(0, b - a, _ROWS):
                d = product(slice(lo, lo + _ROWS), slice(None))
                r, c = _first(d, most, product.error, np.full(len(d), np.inf))
                r += a + lo
                c += a
                out.append(_found(rows, r, rows, c, _exact(x[r], x[c])))
        return pa.concat_tables(out)

    near_rows = cells.select("block", "tile", "u", "v", "ids", "p", "share").groupBy("block", "tile").applyInArrow(within, pairs)
    local = stored(_smallest(near_rows, ["block", "u"], ["d", "j"], most).drop("place"), "local")
    reached = local.groupBy("block", "u").agg(F.count("*").alias("found"), F.max("d").alias("far")).filter(F.col("found") == most).drop("found")

    # What a vector must know of each cell: its pivot, its tiles, the range of its members' distances and the smallest ones.
    closest = _smallest(cells.select("block", "p", F.explode(F.array_repeat("dp", F.size("ids"))).alias("dp")), ["block", "p"], ["dp"], most)
    closest = closest.groupBy("block", "p").agg(F.sort_array(F.collect_list("dp")).alias("close"))
    rings = cells.groupBy("block", "p").agg(F.min("dp").alias("lo"), F.max("dp").alias("hi"), F.any_value("shares").alias("shares"), F.collect_set(F.col("tile").cast("int")).alias("tiles"))
    heads = pivots.join(rings, ["block", "p"]).join(closest, ["block", "p"]).select("block", every, "p", "pv", "lo", "hi", "shares", "tiles", "close")

    def visiting(key: tuple, rows: pa.Table, heads: pa.Table) -> pa.Table:
        x, y, p = _matrix(rows, "v"), _matrix(heads, "pv"), heads.column("p").to_numpy()
        dp, far, own = rows.column("dp").to_numpy(), rows.column("far").to_numpy(), rows.column("p").to_numpy()
        lo, hi, alone = heads.column("lo").to_numpy(), heads.column("hi").to_numpy(), heads.column("shares").to_numpy() == 1
        order = np.argsort(p)
        home = order[np.searchsorted(p, own, sorter=order)]
        to, between = _Products(x, y), _Products(y, y)
        gaps = np.sqrt(between(slice(None), slice(None)) + between.error)
        np.fill_diagonal(gaps, 1.0)  # its own cell is looked at apart
        close = heads.column("close").to_pylist()
        owner = np.repeat(np.arange(len(p)), [len(c) for c in close])
        close = np.concatenate([np.array(c) for c in close])
        tiles = [np.array(t) for t in heads.column("tiles").to_pylist()]
        cell_of, tile_of = np.repeat(np.arange(len(p)), [len(t) for t in tiles]), np.concatenate(tiles)
        taken, radii, where, lists = [], [], [], []
        for a in range(0, len(x), _ROWS):
            some = slice(a, a + _ROWS)
            d2 = to(some, slice(None))
            low, high = np.sqrt(np.maximum(d2 - to.error, 0)), np.sqrt(d2 + to.error)
            radius = far[some].copy()
            open_ = np.flatnonzero(~np.isfinite(radius))
            if len(open_) and len(close) >= most:
                radius[open_] = [np.partition(high[o][owner] + close, most - 1)[most - 1] for o in open_]
            radius = np.where(np.isfinite(radius), radius * (1 + _SLACK), np.inf)
            slack = radius[:, None] + _SLACK * (high + hi)
            plane = (d2 - to.error - (dp[some] ** 2)[:, None]) / (2 * gaps[home[some]]) <= slack
            meets = plane & (low - hi <= slack) & (lo - high <= slack)
            at = np.arange(len(d2))
            meets[at, home[some]] = ~alone[home[some]]
            for t in np.unique(tile_of):
                cols = cell_of[tile_of == t]
                mine = meets[:, cols]
                r = np.flatnonzero(mine.any(axis=1))
                if len(r):
                    taken.append(a + r)
                    radii.append(radius[r])
                    where.append(np.full(len(r), t))
                    lists.append((mine[r].sum(axis=1), p[cols[np.nonzero(mine[r])[1]]]))
        at = pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64), pa.int64())
        counts = np.concatenate([c for c, _ in lists]) if lists else np.zeros(0, np.int64)
        flat = np.concatenate([v for _, v in lists]) if lists else np.zeros(0, np.int64)
        met = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, heads.schema.field("p").type))
        columns = {n: rows.column(n).take(at) for n in ("block", "u", "v", "p", "share")}
        return pa.table({**columns, "tile": pa.array(np.concatenate(where) if where else [], pa.int64()), "radius": pa.array(np.concatenate(radii) if radii else [], pa.float64()), "cells": met})

    balls = cells.join(reached, ["block", "u"], "left").select("block", part, "u", "v", "p", "dp", "share", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    sent = f"block {types['block']}, u {types['u']}, v {types['v']}, p {types['u']}, share long, tile long, radius double, cells array<{types['u']}>"
    visits = stored(balls.groupBy("block", "part").cogroup(heads.groupBy("block", "part")).applyInArrow(visiting, sent), "visits")

    def between(key: tuple, guests: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("p")
        x, y, p, r2 = _matrix(guests, "v"), _matrix(rows, "v"), rows.column("p").to_numpy(), guests.column("radius").to_numpy()
        names, starts = np.unique(p, return_index=True)
        ends = np.append(starts[1:], len(p))
        met = guests.column("cells").combine_chunks()
        visit = np.zeros((len(x), len(names)), bool)
        visit[np.repeat(np.arange(len(x)), met.value_lengths().to_numpy(zero_copy_only=False)), np.searchsorted(names, met.flatten().to_numpy(zero_copy_only=False))] = True
        home, share, shares = guests.column("p").to_numpy(), guests.column("share").to_numpy(), rows.column("share").to_numpy()
        product, out = _Products(x, y), []
        limit = np.square(r2) * (1 + 1e-12) + product.error
        for lo in range(0, len(x), _ROWS):
            some = slice(lo, lo + _ROWS)
            if visit[some].mean() > 0.5:
                d = product(some, slice(None))
                d[~np.repeat(visit[some], ends - starts, axis=1)] = np.inf
            else:
                d = np.full((len(x[some]), len(y)), np.inf)
                for c in np.flatnonzero(visit[some].any(axis=0)):
                    r = np.flatnonzero(visit[some, c])
                    d[r, starts[c] : ends[c]] = product(lo + r, slice(starts[c], ends[c]))
            for r in np.flatnonzero(visit[np.arange(lo, lo + len(d)), np.minimum(np.searchsorted(names, home[some]), len(names) - 1)] & np.isin(home[some], names)):
                c = np.searchsorted(names, home[lo + r])  # its own share of its own cell it has met
                d[r, starts[c] : ends[c]][shares[starts[c] : ends[c]] == share[lo + r]] = np.inf
            r, c = _first(d, most, product.error, limit[some])
            r += lo
            e = _exact(x[r], y[c])
            keep = e <= r2[r]
            out.append(_found(guests, r[keep], rows, c[keep], e[keep]))
        return pa.concat_tables(out)

    crowds = stored(visits.groupBy("block", "tile").agg(F.ceil(F.count("*") / tile).alias("crowds")), "crowds")
    guests = visits.join(F.broadcast(crowds), ["block", "tile"]).withColumn("crowd", F.pmod(F.xxhash64("u"), F.col("crowds")))
    hosts = cells.join(F.broadcast(crowds), ["block", "tile"]).select("block", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)).alias("crowd"), "v", "ids", "p", "share")
    keys = ["block", "tile", "crowd"]
    far_rows = guests.drop("crowds").groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInArrow(_met(between), pairs)
    top = stored(_smallest(local.unionByName(far_rows), ["block", "u"], ["d", "j"], most).drop("place"), "top")

    other = cells.select("block", "p", F.col("u").alias("w"), F.col("share").alias("s"), "tile")
    near = cells.select("block", "p", "u", "share").join(other.drop("tile"), ["block", "p"]).filter("share = s").select("block", "u", "w")
    far = visits.select("block", "tile", "u", F.col("p").alias("home"), "share", F.explode("cells").alias("p")).join(other, ["block", "tile", "p"]).filter("p != home OR share != s").select("block", "u", "w")
    return Search(members, top, near, far)


def _met(compare):
    """compare for the keys that have rows on both sides."""

    def run(key: tuple, guests: pa.Table, rows: pa.Table) -> pa.Table:
        if guests.num_rows and rows.num_rows:
            return compare(key, guests, rows)
        block, u = guests.schema.field("block").type, guests.schema.field("u").type
        return pa.table({"block": pa.array([], block), "u": pa.array([], u), "j": pa.array([], u), "d": pa.array([], pa.float64())})

    return run


def knn_edges(vectors: DataFrame, k: int, cell: int | None = None, tile: int = TILE) -> DataFrame:
    """(block, i, j, d, rank): the k nearest neighbours of each vector(block, id, v array) within its block, ties by id.

    A block with k vectors or fewer gives what there is. An id stands for one vector of its block. An empty table
    gives no rows.
    """
    found = search(vectors, k, cell, tile)
    edges = found.members.join(found.top, ["block", "u"]).filter("i != j").select("block", "i", "j", "d")
    return stored(_smallest(edges, ["block", "i"], ["d", "j"], k).withColumnRenamed("place", "rank"), "edges")
