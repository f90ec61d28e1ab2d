"""Exact nearest neighbours: each row of test against all rows of train.

Distances are ascending and ties go by the train key. The kernel strategy packs rows into tiles; each task holds one tile of
queries, streams tiles of train past it and keeps k candidates a query. Bounds of distances come from matrix products in
single precision; what they can't exclude is computed in double. The native strategy needs no Python. Where distances follow
from inner products, Spark ML's blocked products in single precision give each query more than k likely rows; their distances
are computed in double, and a bound of the products' errors tells whether any other row could be among the k nearest. Queries of
which that isn't sure, and all other metrics, go through a Cartesian product of bounded partitions whose condition is the
distance, with one column a dimension; the k nearest found before limit each query, so that few pairs leave the product. Both
strategies end in a window whose limit is applied before and after the shuffle by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.metrics import UNROLLED, l2_norm, metric as metric_column
from vecloom.sources.shared import cut

#: Metrics that the kernel has.
KERNEL = {"cosine", "euclidean", "l2", "sqeuclidean", "ip", "inner_product", "manhattan", "l1", "chebyshev", "canberra", "braycurtis", "minkowski"}
#: Those whose distances follow from inner products.
_PRODUCTS = {"cosine", "euclidean", "l2", "sqeuclidean", "ip", "inner_product", "minkowski"}
#: Numbers in a distance matrix that is held at once, pairs that are computed in double at once.
_HELD, _NEAR = 1 << 21, 1 << 10
#: Cells a dimension for Canberra and rows that they are cut for, tiles of train in a partition, rows of the first part of a tile.
_CELLS, _FITTED, _TILES, _FIRST = 12, 2048, 8, 128
#: The native strategy: most columns of a vector, rows of train that a task holds, most times that a part of train is larger than the one before.
_COLUMNS, _SIDE, _GROWTH = 256, 1 << 10, 24
#: Rows of train in a partition for its products.
_STREAMED = 1 << 16


def _exact(q: np.ndarray, t: np.ndarray, name: str) -> np.ndarray:
    """Of each row of q to the same row of t: the values that are ordered by, alike in every tile."""
    if name in ("ip", "inner_product"):
        return -np.einsum("ij,ij->i", q, t)
    if name == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", t, t))
        return 1 - np.where(norms == 0, 0, np.einsum("ij,ij->i", q, t) / np.where(norms == 0, 1, norms))
    d = q - t
    if name in ("manhattan", "l1"):
        return np.abs(d).sum(1)
    if name == "chebyshev":
        return np.abs(d).max(1, initial=0)
    if name == "canberra":
        both = np.abs(q) + np.abs(t)
        return (np.abs(d) / np.where(both == 0, 1, both)).sum(1)
    if name == "braycurtis":
        apart, both = np.abs(d).sum(1), np.abs(q + t).sum(1)
        with np.errstate(divide="ignore"):
            return np.where(apart == 0, 0, apart / np.where(apart == 0, 1, both))
    s = np.einsum("ij,ij->i", d, d)
    return s if name == "sqeuclidean" else np.sqrt(s)


class _Filter:
    """Tells which pairs of queries and rows of train may be no farther than each query's limit.

    Where distances follow from inner products: those in single precision, less what rounding can do. Sums of |x - y| and the
    largest one are taken of 16-bit numbers. For Canberra each dimension of train is cut into cells; a query's least distance
    to each cell times a row's cells, as ones and zeros, is a bound. Rows with values that aren't finite are never excluded.
    """

    def __init__(self, q: np.ndarray, t: np.ndarray, name: str):
        self.name, (self.n, self.dim) = name, t.shape
        self.odd_q, self.odd_t = ~np.isfinite(q).all(1), ~np.isfinite(t).all(1)
        self.q, self.t = (np.where(odd[:, None], 0, x) if odd.any() else x for odd, x in ((self.odd_q, q), (self.odd_t, t)))
        if name == "cosine":
            self.q, self.t = (x / np.where((n := np.sqrt(np.einsum("ij,ij->i", x, x))) == 0, 1, n)[:, None] for x in (self.q, self.t))
        most = [np.abs(x).max(initial=0) for x in (self.q, self.t)]
        self.usual = all(m == 0 or 1e-15 < m < 1e15 for m in most)
        kind = np.float32 if self.usual else np.float64
        self.slack = (self.dim + 16) * 2.0**-22
        if name in _PRODUCTS or name == "braycurtis":
            self.qs, self.ts = self.q.astype(kind), self.t.astype(kind)
            self.qn, self.tn = (np.einsum("ij,ij->i", x, x) for x in (self.q, self.t))
        if name == "canberra":
            c = _CELLS
            inner = np.sort(self.t, axis=0)[np.arange(1, c) * self.n // c].T
            self.low = np.concatenate([self.t.min(0)[:, None], inner], 1)
            self.high = np.concatenate([inner, self.t.max(0)[:, None]], 1)
            self.cells = np.zeros((self.n, self.dim * c), np.float32)
            for j in range(self.dim):
                self.cells[np.arange(self.n), np.searchsorted(inner[j], self.t[:, j]) + j * c] = 1
            self.slack = (self.dim * c + 16) * 2.0**-22
        elif name not in _PRODUCTS:  # steps of one size; a difference is wrong by one step at most
            self.usual &= self.dim < 16_000
            far = sum(most) if name == "chebyshev" else sum(np.abs(x).sum(1).max(initial=0) for x in (self.q, self.t))
            self.step = far / (32_000 - (0 if name == "chebyshev" else self.dim)) or 1.0
            if self.usual:
                self.qc = np.rint(self.q / self.step).astype(np.int16)
                self.tc = np.ascontiguousarray(np.rint(self.t / self.step).astype(np.int16).T)

    def near(self, a: slice, limit: np.ndarray) -> np.ndarray:
        """Of the queries in a, those pairs whose distance may be at most limit, one number a query; flat places."""
        with np.errstate(over="ignore", invalid="ignore"):
            near = self._near(a, limit)
        if self.odd_q[a].any():
            near[self.odd_q[a]] = True
        if self.odd_t.any():
            near[:, self.odd_t] = True
        return _places(near)

    def products(self, a: slice) -> tuple[np.ndarray, np.ndarray]:
        """Approximate values that grow with the distances, and how far each query's may be wrong."""
        d = self.qs[a] @ self.ts.T
        most = self.tn.max(initial=0)
        if self.name in ("cosine", "ip", "inner_product"):
            return np.negative(d, out=d), self.slack * np.sqrt(self.qn[a] * most)
        d *= -2
        d += self.tn.astype(d.dtype)
        return d, self.slack * (self.qn[a] + most)  # the square less the query's own

    def limit(self, a: slice, limit: np.ndarray) -> np.ndarray:
        """Distances as values of products()."""
        if self.name == "cosine":
            return limit - 1 + 1e-12
        if self.name in ("ip", "inner_product"):
            return limit
        return np.maximum(limit, 0) ** (1 if self.name == "sqeuclidean" else 2) * (1 + 1e-6) - self.qn[a]

    def _near(self, a: slice, limit: np.ndarray) -> np.ndarray:
        if self.name in _PRODUCTS:
            d, wrong = self.products(a)
            limit = self.limit(a, limit)
            return ~(d > _up(limit + wrong + 1e-6 * np.abs(limit), d.dtype)[:, None])
        if self.name == "canberra":
            q = self.q[a][:, :, None]
            own = np.clip(q, self.low, self.high)
            both = np.abs(q) + np.abs(own)
            own = np.abs(q - own) / np.where(both == 0, 1, both)
            least = own.reshape(len(own), -1).astype(np.float32) @ self.cells.T
            return ~(least > _up(limit * (1 + self.slack), np.float32)[:, None])
        if not self.usual:
            return np.ones((len(limit), self.n), bool)
        near = np.empty((len(limit), self.n), bool)
        rows = max(1, (1 << 16) // self.n)
        least, apart = (np.empty((rows, self.n), np.int16) for _ in range(2))
        dims = range(self.dim if self.name != "chebyshev" else min(self.dim, max(16, self.dim // 2)))  # a part of them excludes nearly all
        steps = limit / self.step * (1 + 1e-6)
        most = np.minimum(np.floor(steps + (1 if self.name == "chebyshev" else self.dim)), 32_767).astype(np.int16)
        for i in range(0, len(limit), rows):
            q = self.qc[a][i : i + rows]
            sums, each = least[: len(q)], apart[: len(q)]
            sums[:] = 0
            for j in dims:
                np.subtract(self.tc[j], q[:, j, None], out=each)
                np.abs(each, out=each)
                (np.maximum if self.name == "chebyshev" else np.add)(sums, each, out=sums)
            if self.name == "braycurtis":  # the divisor is at most the norm of the sum times the square root of dim
                at = slice(a.start + i, a.start + i + len(q))
                by = self.qs[at] @ self.ts.T
                by *= 2
                by += ((1 + 4 * self.slack) * self.qn[at])[:, None].astype(by.dtype)
                by += (self.tn + 4 * self.slack * self.tn.max(initial=0)).astype(by.dtype)
                np.sqrt(np.maximum(by, 0, out=by), out=by)
                by *= _up(steps[i : i + rows] * np.sqrt(self.dim) * (1 + self.slack), by.dtype)[:, None]
                by += self.dim
                near[i : i + rows] = ~(sums > by)
            else:
                np.less_equal(sums, most[i : i + rows, None], out=near[i : i + rows])
        return near


def _places(near: np.ndarray) -> np.ndarray:
    """np.flatnonzero, faster where few are set."""
    near = near.reshape(-1)
    if len(near) % 8:
        return np.flatnonzero(near)
    words = np.flatnonzero(near.view(np.uint64))
    inside = np.flatnonzero(near.reshape(-1, 8)[words])
    return words[inside // 8] * 8 + inside % 8


def _up(x: np.ndarray, kind: type) -> np.ndarray:
    """x in another precision, never less."""
    return np.nextafter(x.astype(kind), np.asarray(np.inf, kind))


class _Nearest:
    """The k nearest of each query of a tile, over tiles of train that are added."""

    def __init__(self, rows: np.ndarray, ids: pa.Array, q: np.ndarray, k: int, name: str, precision: str):
        self.rows, self.ids, self.q, self.k, self.name, self.precision = rows, ids, q, k, name, precision
        self.best = np.full((len(q), k), np.inf)
        self.found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def _kept(self, a: np.ndarray, ids: pa.Array, distance: np.ndarray) -> np.ndarray:
        """The places of the k least of each query, sorted."""
        order = np.lexsort((*_keys(ids), self._own(distance), a))
        a = a[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        return order[rank < self.k]

    def _own(self, distance: np.ndarray) -> np.ndarray:
        return distance.astype(np.float32) if self.precision == "float32" else distance

    def add(self, ids: pa.Array, t: np.ndarray) -> None:
        begin, size, most = 0, len(t), len(t)
        if self.name not in _PRODUCTS:  # a few rows first, for limits; the others by their size, so that cells fit
            first = max(_FIRST, 2 * self.k)
            some = np.arange(0, len(t), max(1, len(t) // first))
            rest = np.delete(np.arange(len(t)), some)
            order = np.concatenate([some, rest[np.argsort(np.abs(t[rest]).sum(1), kind="stable")]])
            ids, t, size, most = ids.take(pa.array(order)), t[order], len(some), max(_FITTED, first) if self.name == "canberra" else len(t)
        while begin < len(t):
            b = slice(begin, min(begin + size, len(t)))
            near, step = _Filter(self.q, t[b], self.name), max(1, _HELD // (b.stop - b.start))
            got = [self._block(near, slice(at, min(at + step, len(self.q))), t[b], ids.slice(begin, b.stop - begin)) for at in range(0, len(self.q), step)]
            a, where, distance = (np.concatenate(x) for x in zip(*got))
            self.found.append((a, ids.take(pa.array(where + begin)), distance))
            begin, size = b.stop, min(size * 4, most)
            if len(self.found) > 16:
                self._fold()

    def _block(self, near: _Filter, at: slice, t: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        limit = self.best[at].max(1)
        if self.name in _PRODUCTS and np.isinf(limit).any() and len(t) >= self.k and not (near.odd_q[at].any() or near.odd_t.any()):
            d, wrong = near.products(at)
            kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1].astype(float)
            flat = _places(~(d > _up(kth + 2 * wrong + 1e-6 * np.abs(kth) + 1e-12, d.dtype)[:, None]))
        else:
            flat = near.near(at, limit)
        out, part = [], max(1, _HELD // max(1, t.shape[1]))
        for i in range(0, len(flat), part):  # many parts only if there are many ties
            a, where = np.divmod(flat[i : i + part], len(t))
            a += at.start
            distance = np.empty(len(a))
            for j in range(0, len(a), _NEAR):
                distance[j : j + _NEAR] = _exact(self.q.take(a[j : j + _NEAR], 0), t.take(where[j : j + _NEAR], 0), self.name)
            fits = ~(self._own(distance) > self.best[a].max(1))
            a, where, distance = a[fits], where[fits], distance[fits]
            out.append((a, where, distance))
            self._lower(a, distance)
            if len(out) > 4:  # many ties
                out = [self._kept_of(out, ids)]
        return self._kept_of(out, ids)

    def _kept_of(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        a, where, distance = (np.concatenate(x) for x in zip(*parts))
        keep = self._kept(a, ids.take(pa.array(where)), distance)
        return a[keep], where[keep], distance[keep]

    def _lower(self, a: np.ndarray, distance: np.ndarray) -> None:
        """Limits with new distances, of queries in ascending order."""
        own = self._own(distance).astype(float)
        order = np.lexsort((own, a))
        a, own = a[order], np.where(np.isnan(own), np.inf, own)[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, own, rank = a[rank < self.k], own[rank < self.k], rank[rank < self.k]
        if len(a):
            at = slice(a[0], a[-1] + 1)
            more = np.full((a[-1] + 1 - a[0], self.k), np.inf)
            more[a - a[0], rank] = own
            self.best[at] = np.partition(np.concatenate([self.best[at], more], 1), self.k - 1, axis=1)[:, : self.k]

    def _fold(self) -> None:
        if self.found:
            a, distance = (np.concatenate([x[c] for x in self.found]) for c in (0, 2))
            ids = pa.chunked_array([x[1] for x in self.found]).combine_chunks()
            keep = self._kept(a, ids, distance)
            self.found = [(a[keep], ids.take(pa.array(keep)), distance[keep])]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        for a, ids, distance in self.found:
            whole = pa.RecordBatch.from_arrays([pa.array(self.rows[a]), self.ids.take(pa.array(a)), ids, pa.array(distance)], names=["row", "q_id", "t_id", "distance"])
            yield from (whole.slice(i, 1 << 16) for i in range(0, whole.num_rows, 1 << 16))


def tiles(df: DataFrame, rows: int) -> DataFrame:
    """(at, tile): the rows of df, in Arrow's stream format, at most so many in a tile; at tells tiles apart."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, TaskContext.get().partitionId() << 32

        def tile() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(out, table.schema) as to:
                to.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["at", "tile"])

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                part = batch.slice(begin, rows - n)
                held.append(part)
                begin, n = begin + part.num_rows, n + part.num_rows
                if n == rows:
                    yield tile()
                    held, n, at = [], 0, at + 1
        if n:
            yield tile()

    return df.mapInArrow(pack, "at bigint, tile binary")


def unpacked(tile: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(tile.as_buffer()).read_all().combine_chunks()


def met(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """(a_at, a, b_at, b): each of n_left tiles with each of n_right, by tasks of one tile on the left and a few on the right.

    Neither side is broadcast; the tiles of a tile on the left come one after another.
    """
    a = left.select(F.col("at").alias("a_at"), F.col("tile").alias("a")).repartitionByRange(max(1, n_left), "a_at")
    b = right.select(F.col("at").alias("b_at"), F.col("tile").alias("b")).repartitionByRange(max(1, -(-n_right // _TILES)), "b_at")
    return a.hint("shuffle_replicate_nl").crossJoin(b)


def tile_rows_of(df: DataFrame, n: int, most: int) -> int:
    """Rows of a tile on the left: fewer for small tables, so that all cores have tasks."""
    return min(most, max(256, -(-n // (4 * df.sparkSession.sparkContext.defaultParallelism))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = column.value_lengths()
    if column.null_count or not pc.all(pc.equal(sizes, dim)).as_py() or column.flatten().null_count:
        raise ValueError(f"vectors must be of {dim} numbers that aren't null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _checked(df: DataFrame, pk: str, vector: str, dim: int | None) -> DataFrame:
    """df with null keys and bad vectors raising an error when they are met."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull())
    if dim is not None:
        bad = bad | (F.size(vector) != dim)
    return df.select(
        F.when(F.col(pk).isNull(), F.raise_error(F.lit(f"{pk} is null")).cast(df.schema[pk].dataType)).otherwise(F.col(pk)).alias("pk"),
        F.when(bad, F.raise_error(F.lit(f"{vector} must hold vectors of {dim} numbers that aren't null")).cast("array<double>")).otherwise(F.col(vector).cast("array<double>")).alias("v"),
    )


def _dim(test: DataFrame, train: DataFrame, vector: str) -> int | None:
    for df in (test, train):
        row = df.select(F.size(vector)).where(F.col(vector).isNotNull()).first()
        if row:
            return row[0]
    return None


def knn(
    test: DataFrame,
    train: DataFrame,
    *,
    vector: str,
    pk: str = "id",
    k: int = 10,
    metric: str = "cosine",
    where: str | None = None,
    precision: str = "double",
    strategy: str = "auto",
    broadcast_bytes: int = 64 << 20,
    tile_rows: int = 1 << 13,
) -> DataFrame:
    """(row, q_id, rk, t_id, distance): the min(k, |train|) nearest rows of train for each row of test.

    where is an SQL condition on train, applied before ranking. Rows of test with the same key each keep their own result,
    told apart by row. A row of train with the same key as the query's is not left out. precision="float32" orders by
    rounded distances. Null keys, and vectors that are null, have null elements or another length, raise an error. A zero
    vector has cosine distance 1. NaN distances come last. tile_rows bounds the rows that a task's distances are computed of
    at once; broadcast_bytes is no longer used, for nothing is broadcast.
    """
    if k < 1:
        raise ValueError("k must be positive")
    name = metric.lower()
    metric_column(name)  # known?
    if precision not in ("double", "float32"):
        raise ValueError("precision is double or float32")
    if strategy not in ("auto", "kernel", "native"):
        raise ValueError("strategy is auto, kernel or native")
    if where:
        train = train.where(F.expr(where))
    dim = _dim(test, train, vector)
    # Numbers are given once: a plan that runs again, as after the loss of an executor, could number rows otherwise.
    queries = _checked(test, pk, vector, dim).withColumn("row", F.monotonically_increasing_id())
    rows = _checked(train, pk, vector, dim)
    if strategy == "native" or (strategy == "auto" and name not in KERNEL):
        found = _native(queries, rows, dim, k, name, precision, tile_rows)
    else:
        if name not in KERNEL:
            raise ValueError(f"the kernel has no metric {metric!r}")
        found = _kernel(queries, rows, dim or 0, k, name, precision, tile_rows)
    if precision == "float32":
        found = found.withColumn("distance", F.col("distance").cast("float"))
    return _ranked(found, k).select("row", "q_id", "rk", "t_id", "distance")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.asc_nulls_last("distance"), "t_id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def _native(queries: DataFrame, rows: DataFrame, dim: int | None, k: int, name: str, precision: str, tile_rows: int) -> DataFrame:
    """Candidates that hold the k nearest of each query, without Python.

    Without products, parts of train hold each other and the last one is the whole: a row that is farther than the kth of a part
    isn't among the k nearest. Parts are chosen by a hash of the key; keys that repeat make limits worse, not results.
    """
    flat = dim is not None and dim <= _COLUMNS and name in UNROLLED
    norms = name in _PRODUCTS

    def side(df: DataFrame, keys: list[Column], c: str) -> DataFrame:
        vector = [F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)).alias(f"{c}{i}") for i in range(dim)] if flat else [F.col("v").alias(c)]  # checked; coalesce only tells that they aren't null
        return cut(df.select(*keys, *vector, *([l2_norm("v").alias(f"{c}_norm")] if norms else [])))

    left = side(queries, [F.col("row"), F.col("pk").alias("q_id")], "q")
    right = side(rows, [F.monotonically_increasing_id().alias("at"), F.col("pk").alias("t_id")], "t")
    vectors = [[F.col(f"{c}{i}") for i in range(dim)] for c in "qt"] if flat else ["q", "t"]
    distance = metric_column(name)(*vectors, *(["q_norm", "t_norm"] if name == "cosine" else []))
    if precision == "float32":
        distance = distance.cast("float")
    n, m, first = left.count(), right.count(), max(_FIRST, 4 * k)
    tile = tile_rows_of(left, n, tile_rows)
    if norms and dim and m > 4 * first and max(n, m) < 1 << 31:
        arrays = [F.array(*v) if flat else F.col(v) for v in vectors]
        return _by_products(left, right, arrays, distance, dim, k, name, n, m, tile)
    rounds = math.ceil(math.log(m / first, _GROWTH)) if m > 4 * first else 0
    for i in range(rounds + 1):
        share = (first / m) ** (1 - i / rounds) if i < rounds else 1
        part = right.where(F.pmod(F.xxhash64("t_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if i < rounds else right
        found = _product(left, -(-n // tile), part, m * share, distance)
        if i < rounds:
            limits = _ranked(found, k).where(F.col("rk") == k).select("row", F.col("distance").alias("limit"))
            left = cut(left.drop("limit").join(limits, "row", "left"))
    return found


def _product(left: DataFrame, n_left: int, right: DataFrame, m: float, distance: Column) -> DataFrame:
    """Pairs with their distances, which are at most left's limit where it has one; about m rows on the right."""
    pairs = left.repartition(max(1, n_left)).hint("shuffle_replicate_nl").crossJoin(right.repartition(max(1, math.ceil(m / _SIDE))))
    if "limit" in left.columns:
        pairs = pairs.where(F.col("limit").isNull() | (distance <= F.col("limit")))  # becomes the product's condition
    return pairs.select("row", "q_id", "t_id", distance.alias("distance"))


def _by_products(left: DataFrame, right: DataFrame, arrays: list[Column], distance: Column, dim: int, k: int, name: str, n: int, m: int, tile: int) -> DataFrame:
    """Candidates of each query: those of the largest inner products if it is sure that no other row is as near, else of _product().

    Products are of rows of usual size. For cosine vectors are divided by their norms. For L2 they get one place more, 1 and less
    half the square, so that the product falls as the distance grows. Of equal vectors one is multiplied; it stands for the k least keys.
    """
    apart = name not in ("cosine", "ip", "inner_product")
    usual = lambda c: (F.col(f"{c}_norm") == 0) | F.col(f"{c}_norm").between(1e-100, 1e15)
    left, right = _numbered(left, "row", "q_at"), _numbered(right, "at", "t_at")

    def features(df: DataFrame, c: str, v: Column, more: Column) -> DataFrame:
        if name == "cosine":
            v = F.transform(v, lambda x: x / F.when(F.col(f"{c}_norm") == 0, 1.0).otherwise(F.col(f"{c}_norm")))
        return df.where(usual(c)).select(F.col(f"{c}_at").alias("id"), (F.concat(v, F.array(more)) if apart else v).cast("array<float>").alias("features"))

    q = features(left, "q", arrays[0], F.lit(1.0)).repartition(-(-n // tile) or 1)
    same = Window.partitionBy(*(c for c in right.columns if c not in ("at", "t_at", "t_id", "t_norm"))).orderBy("t_id", "at").rowsBetween(Window.unboundedPreceding, 0)
    kept = cut(right.where(usual("t")).select("*", F.row_number().over(same).alias("nth"), F.first("t_at").over(same).alias("first")).where(F.col("nth") <= k))
    distinct = kept.where("nth = 1").drop("t_id").join(kept.groupBy(F.col("first").alias("t_at")).agg(F.collect_list("t_id").alias("t_ids")), "t_at")
    t = features(kept.where("nth = 1"), "t", arrays[1], -F.col("t_norm") * F.col("t_norm") / 2).repartition(-(-m // _STREAMED))
    wanted = k + max(6, k // 2)  # a few more than k, so that the last is surely farther than the kth
    near = F.col("near")
    most = _largest_products(q, t, dim + apart, wanted).select("q_at", F.when(F.size(near) == wanted, F.array_min(near["rating"]).cast("double")).alias("least"), F.explode(near["t_at"]).alias("t_at"))
    pairs = most.join(distinct, "t_at").join(left, "q_at").select("row", "q_id", "t_ids", distance.alias("distance"), "least", "q_norm")
    pairs = pairs.withColumn("rk", F.rank().over(Window.partitionBy("row").orderBy("distance"))).where(F.col("rk") <= k)
    pairs = pairs.select("row", "q_id", F.explode("t_ids").alias("t_id"), "distance", "least", "q_norm")
    best = cut(_ranked(pairs, k))  # with the same expression as in the product, so that a limit doesn't exclude its own row

    # Of vectors that aren't among the wanted, no product in single precision is above the least.
    longest, odd = right.agg(F.max(F.when(usual("t"), F.col("t_norm"))), F.count_if(~usual("t"))).first()
    limit, norm, longest = F.col("distance").cast("double"), F.col("q_norm"), F.lit(longest or 0.0)
    if name == "cosine":
        bound, size, slack = 1 - limit, F.lit(1.0), F.lit(1e-6)
    elif not apart:
        bound, size, slack = -limit, norm * longest, 1e-6 * F.abs(limit)
    else:
        square = limit if name == "sqeuclidean" else limit * limit
        longest = F.least(longest, (norm + F.sqrt(square)) * (1 + 1e-6))  # a longer row is farther
        bound, size, slack = (norm * norm - square) / 2, norm * longest + longest * longest / 2, 1e-6 * (norm * norm + square)
    wrong = (dim + 8) * 2.0**-23 * size + slack + 1e-30 * (1 + norm + longest)
    sure = F.col("least").isNull() | (F.col("least") + wrong < bound)
    limits = best.where(F.col("rk") == k).select("row", F.col("distance").alias("limit"), sure.alias("sure"))
    known = left.join(limits, "row", "left")
    found = best.join(limits.where("sure"), "row", "left_semi").select("row", "q_id", "t_id", "distance")
    unsure = cut(known.where("not coalesce(sure, false)"))
    if count := unsure.count():
        found = found.unionByName(_product(unsure, -(-count // tile), right, m, distance))
    if odd:
        found = found.unionByName(_product(known.where("sure"), -(-n // tile), right.where(~usual("t")), odd, distance))
    return found


def _numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df, which is cut, with dense integers from its monotonically increasing numbers."""
    part = F.shiftright(by, 33)
    sizes = dict(df.groupBy(part).count().collect())
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()
    return df.withColumn(name, (F.col(by).bitwiseAND(F.lit((1 << 33) - 1)) + F.get(F.lit(before), part.cast("int"))).cast("int"))


def _largest_products(q: DataFrame, t: DataFrame, dim: int, wanted: int) -> DataFrame:
    """(q_at, near): for each row of q those of t with the largest inner products, as (t_at, rating), from (id, features) each.

    This is how Spark ML recommends items: blocks of q meet blocks of t in a Cartesian product and only the wanted ones of each leave it.
    """
    spark = q.sparkSession
    model = spark._jvm.org.apache.spark.ml.recommendation.ALSModel("products", dim, q._jdf, t._jdf)
    model.setUserCol("q_at")
    model.setItemCol("t_at")
    return DataFrame(model.recommendForAllUsers(wanted), spark).withColumnRenamed("recommendations", "near")


def _kernel(queries: DataFrame, rows: DataFrame, dim: int, k: int, name: str, precision: str, tile_rows: int) -> DataFrame:
    """Candidates that hold the k nearest of each query. A task's memory doesn't grow with either table."""
    q_type, t_type = queries.schema["pk"].dataType.simpleString(), rows.schema["pk"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (at := batch.column(0)[i].as_py()) != now:
                    if state:
                        yield from state.batches()
                    q = unpacked(batch.column(1)[i])
                    now, state = at, _Nearest(q["row"].to_numpy(), q["pk"].combine_chunks(), _matrix(q["v"].combine_chunks(), dim), k, name, precision)
                t = unpacked(batch.column(3)[i])
                state.add(t["pk"].combine_chunks(), _matrix(t["v"].combine_chunks(), dim))
        if state:
            yield from state.batches()

    n, m = queries.count(), rows.count()
    left = cut(tiles(queries.select("row", "pk", "v"), tile_rows_of(queries, n, tile_rows)))
    pairs = met(left, tiles(rows, tile_rows), left.count(), -(-m // tile_rows))
    return pairs.mapInArrow(scan, f"row bigint, q_id {q_type}, t_id {t_type}, distance double")


def _keys(ids: pa.Array) -> tuple[np.ndarray, ...]:
    """A key to sort ids by."""
    if pa.types.is_integer(ids.type):
        return (ids.to_numpy(zero_copy_only=False),)
    return (pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64),)


def pairwise(left: DataFrame, right: DataFrame, *, vector: str, pk: str, digits: int, tile_rows: int = 1 << 12) -> DataFrame:
    """(a_id, b_id, cosine, l2): both distances of each row of left to each of right, rounded (halves away from zero).

    Each task holds two tiles and gives their pairs in batches of bounded size. Vectors that are null, have null elements or
    another length than the first have null distances, as in metrics. A zero vector has cosine distance 1.
    """
    dim = _dim(left, right, vector) or 0
    whole = F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))
    sides = [df.select(F.col(pk).alias("pk"), F.col(vector).cast("array<double>").alias("v"), whole.alias("whole")) for df in (left, right)]
    types = [df.schema[pk].dataType.simpleString() for df in (left, right)]

    def away(x: np.ndarray) -> np.ndarray:
        return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x) + 0.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = unpacked(batch.column(1)[i]), unpacked(batch.column(3)[i])
                q, t = (_matrix(x["v"].combine_chunks(), dim) for x in (a, b))
                qs, ts = (np.einsum("ij,ij->i", x, x) for x in (q, t))
                step = max(1, (1 << 17) // len(t))
                for at in range(0, len(q), step):
                    own = slice(at, at + step)
                    product, both = q[own] @ t.T, qs[own, None] + ts
                    norms = np.sqrt(qs[own])[:, None] * np.sqrt(ts)
                    with np.errstate(invalid="ignore", over="ignore"):
                        cosine = 1 - np.where(norms == 0, 0, product / np.where(norms == 0, 1, norms))
                        square = both - 2 * product
                        x, y = np.nonzero(~(square > 1e-3 * both))  # where much would cancel
                        for j in range(0, len(x), 1 << 12):
                            d = q[at + x[j : j + (1 << 12)]] - t[y[j : j + (1 << 12)]]
                            square[x[j : j + (1 << 12)], y[j : j + (1 << 12)]] = np.einsum("ij,ij->i", d, d)
                        n = len(product)
                        ids = a["pk"].combine_chunks().take(pa.array(np.repeat(np.arange(at, at + n), len(t)))), b["pk"].combine_chunks().take(pa.array(np.tile(np.arange(len(t)), n)))
                        yield pa.RecordBatch.from_arrays([*ids, *(pa.array(away(m).reshape(-1)) for m in (cosine, np.sqrt(square)))], names=["a_id", "b_id", "cosine", "l2"])

    n, m = (df.count() for df in sides)
    fits = [df.where("whole").select("pk", "v") for df in sides]
    first = cut(tiles(fits[0], tile_rows_of(fits[0], n, tile_rows)))
    out = met(first, tiles(fits[1], tile_rows), first.count(), -(-m // tile_rows)).mapInArrow(scan, f"a_id {types[0]}, b_id {types[1]}, cosine double, l2 double")
    odd = [df.where("not whole") for df in sides]
    for x, y in ((odd[0], sides[1]), (sides[0].where("whole"), odd[1])):
        if (y if x is not odd[0] else x).isEmpty():
            continue
        pairs = x.select(F.col("pk").alias("a_id"), F.col("v").alias("a")).crossJoin(y.select(F.col("pk").alias("b_id"), F.col("v").alias("b")))
        out = out.unionByName(pairs.select("a_id", "b_id", F.round(metric_column("cosine")("a", "b"), digits).alias("cosine"), F.round(metric_column("l2")("a", "b"), digits).alias("l2")))
    return out


def neighbours(test: DataFrame, train: DataFrame, *, pk: str = "id", where: str | None = None, **options) -> DataFrame:
    """(pk, neighbors_id), one row for each row of test: the keys of its nearest rows of train, nearest first.

    Options are knn()'s. Without any row in train the arrays are empty. Sort by pk where the order of rows matters.
    """
    kind = f"array<{train.schema[pk].dataType.simpleString()}>"
    if where:
        train = train.where(F.expr(where))
    if train.isEmpty():
        return test.select(pk, F.array().cast(kind).alias("neighbors_id"))
    found = knn(test, train, pk=pk, **options)
    lists = found.groupBy("row", "q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "t_id"))), lambda x: x["t_id"]).alias("neighbors_id"))
    return lists.select(F.col("q_id").alias(pk), F.col("neighbors_id").cast(kind).alias("neighbors_id"))


def merged(parts: list[DataFrame], k: int) -> DataFrame:
    """The top k of several results of knn() over disjoint parts of train, for the same test keys: merged by key, not by place."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("q_id").orderBy("distance", "t_id")
    return every.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("q_id", "rk", "t_id", "distance")
