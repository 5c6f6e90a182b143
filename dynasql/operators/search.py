"""The k nearest rows of a stream for a block of queries, inside one task.

A matrix product gives a lower bound of the distances of a batch of rows to a tile
of queries. Rows that may be among the k nearest by it get their distance exactly as
`vectors.distance` sums it, so results and ties are those of comparing each pair. A task
holds one batch, one tile and the k nearest of each query so far; no pairs leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and queries that meet at a time, and pairs whose exact distances are taken at a time.
ROWS, TILE, PAIRS = 10_000, 256, 1_000_000
#: Squared lengths outside these get no bound, so each of their distances is exact; what underflow may add.
LEAST, MOST, TINY = 1e-280, 1e300, 1e-300


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """(vectors, which are null, lengths found); null vectors are all NaN, and no vectors are given if lengths differ."""
    absent = column.is_null().to_numpy(zero_copy_only=False)
    there = column.drop_null()
    sizes = set(pc.unique(there.value_lengths()).to_pylist())
    out = np.full((len(column), max(sizes, default=0) if len(sizes) < 2 else 0), np.nan)
    if len(sizes) == 1:
        out[~absent] = there.flatten().to_numpy(zero_copy_only=False).reshape(len(there), out.shape[1])
    return out, absent, sizes


def sides(vectors: np.ndarray, hyperplanes: list[list[list[float]]]) -> np.ndarray:
    """One bucket for each vector and table: the sides of the table's hyperplanes, as bits; sums run component by component."""
    out = np.zeros((len(vectors), len(hyperplanes)), np.int64)
    for t, table in enumerate(hyperplanes):
        dots = np.zeros((len(vectors), len(table)))
        for i, plane in enumerate(np.asarray(table).T):
            dots += vectors[:, i : i + 1] * plane
        for bit in ~(dots <= 0).T:  # NaN counts as the greatest number
            out[:, t] = out[:, t] * 2 + bit
    return out


def shared(rows: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Bits (queries x rows) of what shares a bucket in any table: the lists of the queries' buckets, united."""
    n, out = len(rows), np.zeros((len(asks), -(-len(rows) // 8)), np.uint8)
    place, bit = np.arange(n) // 8, (128 >> np.arange(n) % 8).astype(np.uint8)
    for mine, theirs in zip(rows.T, asks.T, strict=True):
        values, which = np.unique(mine, return_inverse=True)
        lists = np.zeros((len(values) + 1, out.shape[1]), np.uint8)
        np.bitwise_or.at(lists, (which, place), bit)
        at = np.searchsorted(values, theirs)
        at[values[np.minimum(at, len(values) - 1)] != theirs] = len(values)
        out |= lists[at]
    return out


def exact(metric: str, parts: Iterator[tuple[np.ndarray, np.ndarray]], shape: tuple[int, ...]) -> np.ndarray:
    """Distances from the components of both sides, summed in the order of `vectors.distance`."""
    total, left, right = (np.zeros(shape) for _ in range(3))
    for x, y in parts:
        if metric == "l2":
            gap = x - y
            total += gap * gap
        elif metric == "l1":
            total += np.abs(x - y)
        else:
            total += x * y
        if metric == "cosine":
            left += x * x
            right += y * y
    if metric == "cosine":
        size = np.sqrt(left) * np.sqrt(right)
        if (size == 0).any():
            raise ValueError("cosine distance of a zero vector")
        return 1 - total / size
    return -total if metric == "inner_product" else total


class Side:
    """Vectors of one side and what bounds their distances: lower bound = queries.factor @ rows.factor.T + queries.add."""

    def __init__(self, vectors: np.ndarray, absent: np.ndarray, metric: str, asks: bool):
        self.vectors, self.absent, self.parts = vectors, absent, np.ascontiguousarray(vectors.T)
        d = vectors.shape[1]
        self.margin = 8 * (d + 8) * np.finfo(float).eps  # of the squared lengths: above all rounding of the product and of the exact sum
        square = np.einsum("ij,ij->i", vectors, vectors)
        self.zero = metric == "cosine" and bool((square == 0).any())
        self.square = np.where((square < MOST) & ((metric != "cosine") | (square > LEAST)), square, np.nan)
        if metric == "cosine":
            unit = vectors / np.sqrt(self.square)[:, None]
            own, rest, self.add = (-unit, 1, np.full(len(unit), 1 - self.margin)) if asks else (unit, 0 * self.square, None)
            self.slack = np.full(len(unit), self.margin)
        else:
            share = (1 - self.margin) * self.square if metric == "l2" else -self.margin * self.square
            own, rest, self.add = ((-2 if metric == "l2" else -1) * vectors, 1, share - TINY) if asks else (vectors, share, None)
            self.slack = self.margin * self.square + TINY
        self.factor = np.column_stack([own, np.broadcast_to(rest, len(vectors))])


def first(k: int, query: np.ndarray, absent: np.ndarray, far: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the k nearest of each query, sorted by query, distance (NaN late, null last) and order."""
    by = np.lexsort((order, far, absent, query))
    own = query[by]
    return by[np.arange(len(by)) - np.searchsorted(own, own) < k]


def copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each distinct vector: no later copy is among the k nearest of any query."""
    if not vectors.size:
        return np.arange(len(vectors))
    _, which = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(which, kind="stable")
    return np.sort(by[np.arange(len(by)) - np.searchsorted(which[by], which[by]) < k])


class Nearest:
    """The k nearest rows of what add() was given so far."""

    def __init__(self, ids: pa.Array, column: pa.Array, k: int, metric: str, hyperplanes: list | None = None):
        vectors, absent, self.sizes = matrix(column)
        self.ids, self.k, self.metric, self.hyperplanes = ids, k, metric, hyperplanes
        with np.errstate(all="ignore"):
            self.asks = Side(vectors, absent, metric, True)
            self.buckets = sides(vectors, hyperplanes) if hyperplanes is not None and len(ids) else None
        self.bound = np.full(len(ids), np.inf)
        self.query, self.absent, self.far, self.found = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0), None

    def add(self, ids: pa.Array, column: pa.Array) -> None:
        if self.k < 1 or not len(self.ids) or not len(ids):
            return
        by = pc.sort_indices(ids, null_placement="at_start")
        vectors, absent, sizes = matrix(column.take(by))
        if sizes and len(sizes | self.sizes) > 1 and self.sizes:
            raise ValueError("vectors differ in length")
        if not self.sizes or not sizes:  # one side is all null
            vectors = np.full((len(ids), self.asks.vectors.shape[1]), np.nan)
        keep = copies(vectors, self.k) if sizes and self.sizes else np.arange(min(self.k, len(ids)))
        ids = ids.take(by).take(pa.array(keep))
        with np.errstate(all="ignore"):
            query, row, none, far = self._meet(Side(vectors[keep], absent[keep], self.metric, False))
        # Merge with what was found before; all ids are ranked anew.
        ids = ids.take(pa.array(row))
        self.found = ids if self.found is None else pa.concat_arrays([self.found, ids])
        self.query, self.absent, self.far = (np.concatenate(p) for p in ((self.query, query), (self.absent, none), (self.far, far)))
        order = np.empty(len(self.found), np.int64)
        order[pc.sort_indices(self.found, null_placement="at_start").to_numpy()] = np.arange(len(order))
        best = first(self.k, self.query, self.absent, self.far, order)
        self.found, self.query, self.absent, self.far = self.found.take(pa.array(best)), self.query[best], self.absent[best], self.far[best]
        last = np.arange(len(best)) - np.searchsorted(self.query, self.query) == self.k - 1
        self.bound[self.query[last]] = np.where(self.absent[last], np.inf, self.far[last])

    def _meet(self, rows: Side) -> tuple[np.ndarray, ...]:
        """(query, row, whether null, distance): the k nearest of these rows, or more than those that come into question."""
        asks, n, k, out = self.asks, len(rows.vectors), self.k, []
        if (asks.zero and not rows.absent.all()) or (rows.zero and not asks.absent.all()):
            raise ValueError("cosine distance of a zero vector")
        pool = None if self.buckets is None else shared(sides(rows.vectors, self.hyperplanes), self.buckets)
        wide = np.nanmax(rows.slack) if np.isfinite(rows.slack).any() else np.nan
        for at in range(0, len(self.ids), TILE):
            tile = slice(at, at + TILE)
            if self.metric == "l1":
                low = exact("l1", ((x[None, :], y[tile, None]) for x, y in zip(rows.parts, asks.parts, strict=True)), (len(asks.absent[tile]), n))
                add = slack = np.zeros(len(low))
            else:
                low, add, slack = asks.factor[tile] @ rows.factor.T, asks.add[tile], asks.slack[tile] + wide
            most = self.bound[tile] - add
            own = None if pool is None else np.unpackbits(pool[tile], axis=1, count=n).view(bool)
            new = ~np.isfinite(self.bound[tile])
            if new.any():  # fewer than k were found: the k-th of these rows bounds what counts
                part = low[new] if own is None else np.where(own[new], low[new], np.inf)
                most[new] = np.partition(part, k - 1, axis=1)[:, k - 1] + 2 * slack[new] if n > k else np.inf
            hit = ~(low > most[:, None])  # NaN: no bound
            if own is not None:
                hit &= own
            hit[asks.absent[tile], k:] = False  # all null: the first by id
            query, row = np.nonzero(hit)
            query += at
            far = np.concatenate([self._far(rows, query[i : i + PAIRS], row[i : i + PAIRS]) for i in range(0, len(query), PAIRS)] or [np.zeros(0)])
            none = asks.absent[query] | rows.absent[row]
            best = first(k, query, none, far, row)
            out.append((query[best], row[best], none[best], far[best]))
        return tuple(np.concatenate(p) for p in zip(*out, strict=True))

    def _far(self, rows: Side, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        return exact(self.metric, ((x[row], y[query]) for x, y in zip(rows.parts, self.asks.parts, strict=True)), (len(row),))

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.query)), self.found, pa.array(self.far, pa.float64(), mask=self.absent)], names)


def search(block, k: int, metric: str, hyperplanes: list | None, id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, vector): the k nearest of a task's rows for each query of block, a broadcast (ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = None
        for batch in batches:
            near = near or Nearest(*block.value, k, metric, hyperplanes)
            for at in range(0, batch.num_rows, ROWS):
                near.add(*(c.slice(at, ROWS) for c in batch.columns))
        if near is not None and near.found is not None:
            yield near.batch(["query_id", id, "distance"])

    return run
