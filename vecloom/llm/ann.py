"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Each tree is an array of vectors sorted by a long string of hash bits, the signs of random projections. A query descends each
tree to the vectors with which it shares the longest prefixes, those beside it in the array. The best of them give a first
estimate s of its k-th neighbour's similarity. Two vectors of similarity s share a bit with probability p = 1 - arccos(s) / pi,
so that trees searched at prefixes of the lengths l1, l2, ... all miss a neighbour at least that near with probability
(1 - p**l1) * (1 - p**l2) * ... at most. The trees then ascend together, one bit at a time and in turn, until that is below
1 - recall. At the similarity 0 that is at a length of 2 or 3; no tree ascends to its root.

Queries are a stated set, every row whose id is divisible by a number; all rows are answers. Vectors travel once per tree, a byte
for each dimension, to the cell of their leading bits, and queries that ascend beyond a cell meet the wider prefix, cut into
tiles. What is best by the bytes, and all that may be better for their rounding, is then compared by the vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import cut, map_arrow
from vecloom.llm.vectors import keyed, matrix, restored, similarities, small, unit, unsure

BITS = 60
_BLOCK = 1 << 22


def hashed(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """(id, asks, dim, h, q, scale, lost) of (id, asks, v): one hash string of BITS bits for each tree, and the small vector."""

    def start():
        planes: dict[int, np.ndarray] = {}

        def step(batch):
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                if dim not in planes:
                    planes.clear()
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), trees * BITS)).astype(np.float32)
                for at in range(0, part.num_rows, 2048):
                    own = part.slice(at, 2048)
                    u = unit(matrix(own.column(2)))
                    bits = ((u.astype(np.float32) @ planes[dim]) > 0).reshape(len(u), trees, BITS)
                    h = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    q, scale, lost = small(u)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, trees, dtype=np.int32)), pa.array(h.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(u), dim, np.int32)), lists, q, pa.array(scale), pa.array(lost)], names=["id", "asks", "dim", "h", "q", "scale", "lost"])

        return step

    return map_arrow(rows, "id bigint, asks boolean, dim int, h array<bigint>, q binary, scale float, lost float", start)


def descend(rows: DataFrame, some: int, lead: int) -> DataFrame:
    """(a, b): for each row that asks, in each tree, the `some` rows on each side with which it shares the longest prefixes.

    Trees are sorted arrays, cut at prefixes of lead bits.
    """

    def beside(table: pa.Table) -> pa.Table:
        h, ids = table.column("h").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, h))
        ids = ids[order]
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False)[order])
        a, b = [], []
        for k in [*range(-some, 0), *range(1, some + 1)]:
            at = asks[(asks + k >= 0) & (asks + k < len(ids))]
            a.append(ids[at])
            b.append(ids[at + k])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    each = rows.select("id", "asks", "dim", F.posexplode("h").alias("tree", "h")).withColumn("cell", F.shiftright("h", BITS - lead) if lead else F.lit(0))
    return each.groupBy("dim", "tree", "cell").applyInArrow(beside, "a bigint, b bigint").distinct()


def _lengths(s: np.ndarray, trees: int, recall: float) -> np.ndarray:
    """The prefix length in each tree, for each estimate s of the k-th similarity; -1 where the tree isn't needed."""
    with np.errstate(divide="ignore"):
        p = 1 - np.arccos(np.clip(s, -1, 1)) / math.pi
        lengths = np.arange(BITS + 1)
        miss = np.log1p(-np.minimum(p[:, None] ** lengths, 1 - 1e-15))  # of one tree
        ok = trees * miss <= math.log(1 - recall)
        low = np.where(ok.any(1), ok.shape[1] - 1 - ok[:, ::-1].argmax(1), 0)  # the longest that is enough if all trees use it
        high = np.minimum(low + 1, BITS)
        at = np.arange(len(s))
        gain = miss[at, high] - miss[at, low]
        need = np.ceil(np.where(gain > 0, (trees * miss[at, high] - math.log(1 - recall)) / np.where(gain > 0, gain, 1), trees))
    need = np.clip(need, 0, trees)
    out = np.where(np.arange(trees) < need[:, None], low[:, None], high[:, None])
    root = low == 0
    out[root] = -1
    out[root, 0] = 0
    return out


def search(rows: DataFrame, asked: DataFrame, k: int, lead: int, tile: int) -> DataFrame:
    """(a, b): for each of asked (id, ls, s) candidates that hold, of the rows that share one of its prefixes, the k most similar.

    ls has a prefix length for each tree, -1 where it isn't searched; rows of a similarity below s are left out.
    """
    used = [r[0] for r in asked.select(F.explode("ls").alias("l")).where(f"l >= 0 and l < {lead}").distinct().collect()]  # at most lead lengths
    levels = F.array(*(F.lit(x).cast("int") for x in sorted({lead, *used})))
    own = rows.join(asked, "id", "left").select("id", "dim", "q", "scale", "lost", "s", F.posexplode(F.arrays_zip("h", F.coalesce("ls", F.transform("h", lambda _: F.lit(-1))).alias("ls"))).alias("tree", "x"))
    each = own.select("id", "dim", "q", "scale", "lost", "s", "tree", F.col("x.h").alias("h"), F.col("x.ls").alias("own"), F.explode(levels).alias("bits"))
    key = ["dim", "tree", "bits", "prefix"]
    here = F.when((F.col("own") >= 0) & (F.col("bits") == F.least("own", F.lit(lead))), F.col("own"))
    each = each.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - bits)")).withColumn("l", here)
    sized = each.select(*key, "l").groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count("l").alias("n")).where("n > 0").select(*key, F.ceil(F.col("m") / F.lit(tile)).cast("int").alias("cuts"))
    placed = each.join(sized, key)
    # An answer is in one tile of its cell; a query goes to each.
    tiles = F.expr("""concat(array(named_struct('c', pmod(xxhash64(id), cuts), 'l', cast(null as int))),
        if(l is null, array(), transform(sequence(0, cuts - 1), c -> named_struct('c', cast(c as bigint), 'l', l))))""")
    met = placed.select("id", "q", "scale", "lost", "s", "h", *key, F.explode(tiles).alias("x")).select("id", "q", "scale", "lost", "s", "h", *key, "x.c", "x.l")

    def best(table: pa.Table) -> pa.Table:
        ids, h, level, floor, scale, lost = (table.column(c).to_numpy() for c in ("id", "h", "l", "s", "scale", "lost"))
        u = restored(table.column("q").combine_chunks(), scale)
        asks = ~np.isnan(level)
        m = np.flatnonzero(~asks)
        m = m[np.argsort(h[m], kind="stable")]
        q = np.flatnonzero(asks)
        level = np.where(asks, level, 0).astype(np.int64)
        q = q[np.lexsort((h[q] >> (BITS - level[q]), level[q]))]
        p = h[q] >> (BITS - level[q])
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (level[q][1:] != level[q][:-1])]) if len(q) else []
        mh, mu, mi, ml = h[m], u[m], ids[m], lost[m]
        got_q, got_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(first, [*first[1:], len(q)]):
            shift = BITS - level[q[a]]
            lo, hi = np.searchsorted(mh, [p[a] << shift, (p[a] + 1) << shift])
            n = hi - lo
            if not n:
                continue
            rows_at = max(1, _BLOCK // n)
            for at in range(a, b, rows_at):
                qs = q[at : at + min(rows_at, b - at)]
                s = u[qs] @ mu[lo:hi].T
                s[ids[qs][:, None] == mi[lo:hi][None, :]] = -3
                doubt = unsure(lost[qs][:, None], ml[lo:hi].max())
                least = floor[qs][:, None] - doubt
                if n > k:  # the k-th is at least as similar as this, and so are all that are wanted
                    least = np.maximum(least, np.partition(s, n - k, axis=1)[:, n - k][:, None] - 2 * doubt)
                r, c = np.nonzero(s >= np.maximum(least, -2))
                got_q.append(ids[qs][r])
                got_m.append(mi[lo:hi][c])
        return pa.table({"a": np.concatenate(got_q), "b": np.concatenate(got_m)})

    return met.groupBy(*key, "c").applyInArrow(best, "a bigint, b bigint").distinct()


def neighbours(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    every: int = 100,
    trees: int = 16,
    recall: float = 0.93,
    some: int = 10,
    cell_rows: int = 1 << 14,
    seed: int = 5,
) -> DataFrame:
    """(id, rank, neighbour, similarity): the k rows with the largest cosine to each row whose id is divisible by `every`.

    All rows are answers; ranks are counted from 1. Each of the true ones is found with a probability of about recall at
    least. Equal similarities go by id: equal vectors are searched for once, and stand for the k + 1 least ids that have
    them. A row is not its own neighbour, nor is another row of its id; of such rows each is a query's answer by its best one.
    Vectors are compared as float32, and only with those of the same length. Rows whose id or vector is null, and vectors
    with nulls, NaN or infinity, all-zero or empty ones have no neighbours and are nobody's. Fewer than k other rows give
    fewer neighbours. An empty table gives an empty result. Other columns are not looked at.
    """
    own = keyed(vectors, id_col, vector_col).where("k0 is not null")
    order = Window.partitionBy("k0", "k1").orderBy("id")
    least = own.select("k0", "k1", "id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    bearers = cut(least.groupBy("k0", "k1").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # at most k + 1 each
    asking = cut(own.where(F.col("id") % every == 0).select("k0", "k1", "id").distinct())
    distinct = own.groupBy("k0", "k1").agg(F.first("v").alias("v"))
    asked = asking.select("k0", "k1").distinct().withColumn("asks", F.lit(True))
    nodes = cut(distinct.join(asked, ["k0", "k1"], "left").select(F.monotonically_increasing_id().alias("id"), "k0", "k1", F.coalesce("asks", F.lit(False)).alias("asks"), "v"))
    rows = cut(hashed(nodes.select("id", "asks", "v"), trees, seed))
    n = rows.count()
    lead = max(0, math.ceil(math.log2(max(n, 1) / cell_rows)))
    first = cut(similarities(descend(rows, max(some, k), lead), nodes.select("id", "v")))
    by = Window.partitionBy("a").orderBy(F.desc("similarity"))
    kth = first.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select(F.col("a").alias("id"), "similarity")
    known = rows.where("asks").select("id").join(kth, "id", "left").select("id", F.coalesce("similarity", F.lit(-2.0)).alias("s"))

    def start():
        def step(batch):
            s = batch.column(1).to_numpy()
            lengths = _lengths(np.maximum(s, 0), trees, recall).astype(np.int32)
            ls = pa.ListArray.from_arrays(pa.array(np.arange(0, lengths.size + 1, trees, dtype=np.int32)), pa.array(lengths.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ls, batch.column(1)], names=["id", "ls", "s"])

        return step

    wanted = cut(map_arrow(known, "id bigint, ls array<int>, s double", start))
    wider = search(rows, wanted, k, lead, 4 * cell_rows).join(first.select("a", "b"), ["a", "b"], "left_anti")
    found = first.unionByName(similarities(wider, nodes.select("id", "v")))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b")))
    # Equal similarities go by id, so those of the k-th stay, too; vectors of several rows come once.
    edge = found.where(F.col("r") <= k).groupBy("a").agg(F.min("similarity").alias("edge"))
    found = found.join(edge, "a").where("similarity >= edge").select("a", "b", "similarity")
    itself = rows.where("asks").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    names = nodes.select(F.col("id").alias("b"), "k0", "k1").join(bearers, ["k0", "k1"]).select("b", "ids")
    answers = found.unionByName(itself).join(names, "b").select("a", "similarity", F.explode("ids").alias("other"))
    answers = answers.groupBy("a", "other").agg(F.max("similarity").alias("similarity"))
    answers = answers.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "other"))).where(F.col("r") <= k + 1)
    ids = asking.join(nodes.select("k0", "k1", F.col("id").alias("a")), ["k0", "k1"]).select("a", F.col("id").alias("query"))
    each = ids.join(answers, "a").where("query <> other").groupBy("query", "other").agg(F.max("similarity").alias("similarity"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").cast(vectors.schema[id_col].dataType).alias(id_col), "rank", F.col("other").alias("neighbour"), F.round("similarity", 6).alias("similarity"))
