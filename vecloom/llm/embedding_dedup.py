"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of few dimensions. If the squared distance of two vectors is at most R, then in at
least one block it is at most that block's share of R, in proportion to its dimensions. Each block is joined under its share: a
k-d tree cuts it into leaves, and a vector goes to its own leaf and, as a visitor, to each later leaf that is near enough, so
that two vectors meet in one leaf a block. The candidates of all blocks are compared exactly, by all dimensions.

What travels is a byte for each dimension. It tells nearly all candidates; those that it leaves open, and that nothing else
has linked by then, are compared by their vectors.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut, map_arrow
from vecloom.llm.components import components, merge
from vecloom.llm.vectors import keyed, matrix, restored, similarities, small, unit, unsure

_BLOCK = 1 << 18
_SLACK = 1e-5
#: Only the leaves' borders come from a sample, of about so many rows; what is found doesn't depend on them.
_SAMPLE = 1 << 18
_COMPARED = 1 << 15


@lru_cache(maxsize=2)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def spans(dim: int, width: int) -> list[tuple[int, int]]:
    """Blocks of about width dimensions."""
    at = np.linspace(0, dim, max(1, round(dim / width)) + 1).round().astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class Leaves:
    """A k-d tree: inner node n has children 2n + 1 and 2n + 2; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, np.int64)
        self.value = np.zeros((1 << depth) - 1)
        parts = [sample]
        for n in range(len(self.axis)):
            x = parts[n]
            if len(x):
                self.axis[n] = np.argmax(np.var(x, axis=0))
                self.value[n] = np.median(x[:, self.axis[n]])
            right = x[:, self.axis[n]] >= self.value[n]
            parts += [x[~right], x[right]]
            parts[n] = None

    def meet(self, x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, is its home) for each row's home and all later leaves that are at most the root of share away."""
        row, node, off, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(x.shape), np.ones(len(x), bool)
        for _ in range(self.depth):
            axis = self.axis[node]
            v = x[row, axis] - self.value[node]
            right = v >= 0
            at = np.arange(len(row))
            far = off.copy()
            far[at, axis] = np.maximum(far[at, axis], np.abs(v))
            # A home's left neighbours are met by their own visitors.
            go = (np.einsum("ij,ij->i", far, far) <= share) & ~(home & right)
            near_child, far_child = 2 * node + 1 + right, 2 * node + 2 - right
            row, node, off, home = np.r_[row, row[go]], np.r_[near_child, far_child[go]], np.r_[off, far[go]], np.r_[home, np.zeros(go.sum(), bool)]
        return row, node - ((1 << self.depth) - 1), home


def _tiles(row, cell, home, chunk, cuts):
    """(row, cell, a, b, role): roles are 0 for both sides, 1 for a member, 2 for a query; queries meet members in tile (a, b)."""
    for s in np.unique(cuts):
        own = cuts == s
        r, c, h, k = row[own], cell[own], home[own], chunk[own] % s
        for j in range(s):
            at = np.flatnonzero(h)
            yield r[at], c[at], np.full(len(at), j), k[at], np.where(k[at] == j, 0, 1)
            at = np.flatnonzero(~h | (k < j))
            yield r[at], c[at], k[at], np.full(len(at), j), np.full(len(at), 2)


def links(rows: DataFrame, least: float, width: int, leaf_rows: int, seed: int) -> DataFrame:
    """(a, b, open) such that the components of these links are those of all pairs of rows (id, v) with a cosine of least or more.

    Links that are open are still to be compared by their vectors.
    """
    limit = 2 - 2 * least
    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().collect()}
    trees: dict[int, list[Leaves]] = {}
    for dim, n in sizes.items():
        part = rows.where(F.size("v") == dim).where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // _SAMPLE))) == 0).select("v").toArrow().column("v").combine_chunks()
        x = unit(matrix(part)) @ rotation(dim, seed) if len(part) else np.zeros((0, dim))
        depth = min(max(0, math.ceil(math.log2(n / leaf_rows))), max(0, int(math.log2(max(len(x), 16) / 16))))
        trees[dim] = [Leaves(x[:, a:b], depth) for a, b in spans(dim, width)]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    def placed(batch):
        """For each length and block of a batch: (dim, block, places in the batch, row, leaf, home)."""
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            x = unit(matrix(batch.column(1).take(pa.array(at)))) @ rotation(int(dim), seed)
            for block, (a, b) in enumerate(spans(int(dim), width)):
                row, leaf, home = shared.value[int(dim)][block].meet(x[:, a:b], (limit + _SLACK) * (b - a) / dim)
                yield int(dim), block, at, row, leaf, home

    def start_counts():
        def step(batch):
            for dim, block, _, _, leaf, home in placed(batch):
                homes, all_ = np.bincount(leaf[home]), np.bincount(leaf)
                homes = np.pad(homes, (0, len(all_) - len(homes)))
                some = np.flatnonzero(all_)
                cols = [np.full(len(some), dim, np.int32), np.full(len(some), block, np.int32), some.astype(np.int32), homes[some], all_[some]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["dim", "block", "leaf", "homes", "met"])

        return step

    # At most a row for each leaf, of which there are no more than _SAMPLE / 16 a block.
    counts = map_arrow(rows.select("id", "v"), "dim int, block int, leaf int, homes bigint, met bigint", start_counts)
    large = counts.groupBy("dim", "block", "leaf").agg(F.sum("homes").alias("homes"), F.sum("met").alias("met")).where(F.greatest(F.col("homes"), F.col("met") / 4) > _COMPARED).collect()
    cuts_of = spark.sparkContext.broadcast({(r[0], r[1], r[2]): math.ceil(max(r[3], r[4] / 4) / _COMPARED) for r in large})

    def start():
        def step(batch):
            ids = batch.column(0).to_numpy()
            for dim, block, at, row, leaf, home in placed(batch):
                cuts = np.ones(len(row), np.int64)
                for (d, k, cell), s in cuts_of.value.items():
                    if (d, k) == (dim, block):
                        cuts[leaf == cell] = s
                dense = unit(matrix(batch.column(1).take(pa.array(at))))
                q, scale, lost = small(dense)
                for r, c, a, b, role in _tiles(row, leaf, home, ids[at][row] & 0xFFFFFFFF, cuts):
                    for lo in range(0, len(r), 1 << 14):
                        cut_ = slice(lo, lo + (1 << 14))
                        own = r[cut_]
                        cols = [np.full(len(own), x, np.int32) for x in (dim, block)] + [x[cut_].astype(np.int32) for x in (c, a, b, role)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), batch.column(0).take(pa.array(at[own])), q.take(pa.array(own)), pa.array(scale[own]), pa.array(lost[own])], names=names)

        return step

    names = ["dim", "block", "leaf", "a", "b", "role", "id", "q", "scale", "lost"]

    def compare(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        lo, hi = spans(dim, width)[block]
        order = np.lexsort((table.column("id").to_numpy(), table.column("role").to_numpy()))
        role, ids, scale, lost = (table.column(c).to_numpy()[order] for c in ("role", "id", "scale", "lost"))
        u = restored(table.column("q").combine_chunks().take(pa.array(order)), scale)
        part = u @ rotation(dim, seed)[:, lo:hi].astype(np.float32)
        square = np.einsum("ij,ij->i", part, part)
        # By rounding a block may seem farther than it is.
        share = (math.sqrt((limit + _SLACK) * (hi - lo) / dim) + 2 * float(lost.max(initial=0))) ** 2 + 1e-6
        queries, members = np.flatnonzero(role != 1), np.flatnonzero(role != 2)
        labels = np.arange(len(ids))
        step = max(1, _BLOCK // max(1, len(members)))
        # One product gives the squared distance less the query's own square.
        side = np.vstack([-2 * part[members].T, square[members]])
        asks = np.hstack([part, np.ones((len(part), 1), np.float32)])
        open_ = []
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            found = np.flatnonzero(asks[q] @ side <= (share - square[q])[:, None])
            for k in range(0, len(found), 1 << 14):
                x, y = q[found[k : k + (1 << 14)] // len(members)], members[found[k : k + (1 << 14)] % len(members)]
                differ = labels[x] != labels[y]
                x, y = x[differ], y[differ]
                cosine, doubt = np.einsum("ij,ij->i", u[x], u[y]), unsure(lost[x], lost[y])
                near = cosine - doubt >= least
                if near.any():
                    merge(labels, x[near], y[near])
                close = ~near & (cosine + doubt >= least)
                if close.any():
                    open_.append((x[close], y[close]))
        joined = np.flatnonzero(labels != np.arange(len(ids)))
        x, y = map(np.concatenate, zip(*open_)) if open_ else (joined[:0], joined[:0])
        differ = labels[x] != labels[y]
        x, y = x[differ], y[differ]
        a, b = np.r_[ids[joined], np.maximum(ids[x], ids[y])], np.r_[ids[labels[joined]], np.minimum(ids[x], ids[y])]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "open": pa.array(np.arange(len(a)) >= len(joined))})

    met = map_arrow(rows.select("id", "v"), "dim int, block int, leaf int, a int, b int, role int, id bigint, q binary, scale float, lost float", start)
    return met.groupBy("dim", "block", "leaf", "a", "b").applyInArrow(compare, "a bigint, b bigint, open boolean")


def deduplicate(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least_cosine: float = 0.95,
    block_dims: int = 8,
    leaf_rows: int = 1 << 13,
    seed: int = 3,
) -> DataFrame:
    """(id, group_id, keep) for each row of vectors; other columns are not looked at.

    Rows whose cosine is least_cosine or more are linked, and linked rows form a group, whose group_id is its least id; keep
    marks that row. A row without copies is its own group. Vectors are compared as float32, and only with those of the same
    length. Null and empty vectors, all-zero ones and those with nulls, NaN or infinity are never copies. Each row is in the
    group of its own vector, whatever its id; repeated rows share their fate; a null id has a null group and is kept. Ids must be integers. An empty table gives an empty result.
    """
    if not 0 < least_cosine <= 1:
        raise ValueError("least_cosine must be above 0 and at most 1")
    own = keyed(vectors, id_col, vector_col)
    # Equal vectors are one; only it is searched for.
    distinct = cut(own.where("k0 is not null").groupBy("k0", "k1").agg(F.min("id").alias("id"), F.first("v").alias("v")))
    rows = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not rows.isEmpty():  # an id with several vectors: each has a number of its own
        distinct = cut(distinct.withColumn("first", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
    else:
        distinct = distinct.withColumn("first", F.col("id"))
    found = cut(links(distinct.select("id", "v"), least_cosine, block_dims, leaf_rows, seed))
    checked = similarities(found.where("open").select("a", "b").distinct(), distinct.select("id", "v")).where(F.col("similarity") >= least_cosine)
    roots = components(found.where("not open").select("a", "b").unionByName(checked.select("a", "b")))
    placed = cut(distinct.join(roots, distinct["id"] == roots["node"], "left").select("k0", "k1", "first", F.coalesce("root", "id").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("first").alias("group_id")))
    groups = cut(placed.join(least, "root").select("k0", "k1", "group_id"))
    own = own.select("id", "k0", "k1")
    every = own.where("k0 is not null").join(groups, ["k0", "k1"]).select("id", "group_id").unionByName(own.where("k0 is null").select("id", F.col("id").alias("group_id")))
    kind = vectors.schema[id_col].dataType
    return every.select(F.col("id").cast(kind).alias(id_col), "group_id", F.coalesce(F.col("id") == F.col("group_id"), F.lit(True)).alias("keep"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, n.b FROM reach r JOIN near n ON r.other = n.a)
SELECT vec_id, min(other) AS group_id, vec_id = min(other) AS keep FROM reach GROUP BY vec_id
"""
