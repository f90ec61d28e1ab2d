"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

Two signatures of 128 bits that differ in at most `radius` bits differ, in at least one of m groups of bits, in at most
that group's threshold, if the thresholds add up to radius - m + 1: else they would differ in more than radius bits.
Groups hold bits that go together, so that the other groups tell more. How many groups there are, and so how wide they
are, and their thresholds come from a dynamic program over estimated candidates: the more signatures, the wider the groups.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut, map_arrow, row_key, slices
from vecloom.llm.components import components, merge

WORD = re.compile(r"\w+")
BITS = 128
#: Numbers of groups that are weighed against each other.
COUNTS = range(5, 14)
#: Signatures of a chunk; a task compares two chunks at most.
CHUNK_ROWS = 1 << 19
#: What a candidate, a probe and the sending of a row cost, in nanoseconds.
_CANDIDATE, _PROBE, _SENT = 12, 30, 1500
_MOST = 8
_CACHED = 300_000
_BLOCK = 1 << 17
_SHIFTS = 8


class Signer:
    """Signatures of texts: each bit is the majority of that bit among the hashes of the distinct words."""

    def __init__(self):
        self.cache: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        words = set(WORD.findall(text.lower()))
        if not words:
            return xxhash.xxh3_128_digest(text.strip().encode("utf-8", "surrogatepass"))
        cache = self.cache
        try:
            joined = b"".join(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > _CACHED:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass"))
            joined = b"".join(map(cache.__getitem__, words))
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(joined), 16 * 250):
            part = np.unpackbits(np.frombuffer(joined[at : at + 16 * 250], np.uint8).reshape(-1, 16), axis=1)
            ones += np.add.reduce(part, axis=0, dtype=np.uint8)
        return np.packbits(ones * 2 > len(words)).tobytes()


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k0, k1, s0, s1) for each row: two hashes of the id and the text, and the signature, null for a null text.

    A text without words is signed as a whole.
    """

    def start():
        sign = Signer()

        def step(batch):
            for part in slices(batch, 3):
                texts = part.column(3).to_pylist()
                null = np.array([t is None for t in texts])
                s = np.frombuffer(b"".join(bytes(16) if t is None else sign(t) for t in texts), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(s[:, 0], mask=null), pa.array(s[:, 1], mask=null)], names=["id", "k0", "k1", "s0", "s1"])

        return step

    return map_arrow(keyed(docs, id_col, text_col).select("id", "k0", "k1", "text"), "id bigint, k0 bigint, k1 bigint, s0 bigint, s1 bigint", start)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k0, k1) of each row."""
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return own.select("id", "text", row_key("id", "text", seed=1).alias("k0"), row_key("id", "text", seed=2).alias("k1"))


@dataclass
class Plan:
    """An order of the bits, of which each run [a, b) of spans is a group with a threshold, -1 for one that isn't searched."""

    order: list[int]
    spans: list[tuple[int, int]]
    limits: list[int]


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    s = np.stack([batch.column("s0").to_numpy(), batch.column("s1").to_numpy()], axis=1)
    return np.unpackbits(s.astype(">i8").view(np.uint8).reshape(len(s), 16), axis=1)


def correlations(distinct: DataFrame) -> np.ndarray:
    """How much the bits go together, among all signatures."""

    def start():
        def step(batch):
            for at in range(0, batch.num_rows, 1 << 15):
                b = _bits(batch.slice(at, 1 << 15)).astype(np.float32)
                n = (b.T @ b).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(n.ravel()), pa.array(np.full(BITS * BITS, len(b), np.int64))], names=["at", "n", "of"])

        return step

    rows = map_arrow(distinct.select("s0", "s1"), "at int, n bigint, of bigint", start).groupBy("at").agg(F.sum("n"), F.sum("of")).collect()
    if not rows:
        return np.eye(BITS)
    both = np.zeros(BITS * BITS)
    for at, n, of in rows:
        both[at] = n / of
    both = both.reshape(BITS, BITS)
    p = both.diagonal()
    var = np.maximum(p * (1 - p), 1e-12)
    return np.abs((both - np.outer(p, p)) / np.sqrt(np.outer(var, var)))


def spans_of(groups: int) -> list[tuple[int, int]]:
    at = np.linspace(0, BITS, groups + 1).round().astype(int).tolist()
    return list(zip(at[:-1], at[1:]))


def bit_groups(corr: np.ndarray, spans: list[tuple[int, int]]) -> list[int]:
    """An order of the bits in which each span holds bits that go together."""
    left, order = np.ones(BITS, bool), []
    for a, b in spans:
        own = np.where(left & left[:, None], corr, 0)
        np.fill_diagonal(own, 0)
        near = np.sort(own, axis=1)[:, BITS - (b - a) + 1 :].sum(1)
        group = [int(np.where(left, near, -1).argmax())]
        left[group[0]] = False
        while len(group) < b - a:
            best = int(np.where(left, corr[:, group].sum(1), -1).argmax())
            group.append(best)
            left[best] = False
        order += group
    return order


def pair_distances(distinct: DataFrame, plans: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """For each number of groups, the share of pairs of signatures that differ in e bits of group g, at [g, e].

    Each signature is compared with some others of its batch. As signatures are spread by a hash, those are as good as any.
    """
    masks = {}
    for m, order in plans.items():
        bits = np.zeros((m, BITS), np.uint8)
        for g, (a, b) in enumerate(spans_of(m)):
            bits[g, order[a:b]] = 1
        masks[m] = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)

    def start():
        def step(batch):
            n = batch.num_rows
            if n < 2:
                return
            s0, s1 = (batch.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1"))
            shifts = np.unique(np.linspace(1, n - 1, _SHIFTS).astype(int))
            x0, x1 = (np.concatenate([s ^ np.roll(s, k) for k in shifts]) for s in (s0, s1))
            out = []
            for m, own in masks.items():
                for g, (a, b) in enumerate(own):
                    e = np.bincount(np.bitwise_count(x0 & a) + np.bitwise_count(x1 & b), minlength=1)
                    out += [(m, g, int(k), int(e[k])) for k in np.flatnonzero(e)]
            m, g, e, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(g, pa.int32()), pa.array(e, pa.int32()), pa.array(c, pa.int64())], names=["m", "g", "e", "n"])

        return step

    out = {m: np.zeros((m, BITS + 1)) for m in plans}
    for m, g, e, n in map_arrow(distinct.select("s0", "s1"), "m int, g int, e int, n bigint", start).groupBy("m", "g", "e").agg(F.sum("n")).collect():
        out[m][g, e] = n
    return {m: x / max(1.0, x[0].sum()) for m, x in out.items()}


def thresholds(shares: np.ndarray, widths: list[int], rows: int, radius: int, lead: int = 0) -> tuple[float, list[int]]:
    """The cost and the thresholds of groups, of sum radius - groups + 1, with the least cost; -1 skips a group."""
    groups = len(widths)
    need = radius - groups + 1
    within = np.cumsum(shares, axis=1)
    count = lambda w, t: sum(math.comb(w, e) for e in range(t + 1))
    cost = {(g, -1): 0.0 for g in range(groups)}
    for g, w in enumerate(widths):
        for t in range(min(_MOST, w) + 1):
            cost[g, t] = rows * rows / 2 * within[g, t] * _CANDIDATE + rows * count(w, t) * _PROBE + rows * count(min(lead, w), t) * _SENT
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in range(groups):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t in range(-1, min(_MOST, widths[g]) + 1):
                new = (c + cost[g, t], [*chosen, t])
                if total + t not in step or new < step[total + t]:
                    step[total + t] = new
        best = step
    return best.get(need, (math.inf, []))


def _lead(rows: int, chunk_rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / chunk_rows)))


def plan(distinct: DataFrame, rows: int, radius: int, chunk_rows: int = CHUNK_ROWS) -> Plan:
    """The groups and thresholds of the least cost for so many signatures."""
    corr = correlations(distinct)
    orders = {m: bit_groups(corr, spans_of(m)) for m in COUNTS if radius - m + 1 >= -m}
    shares = pair_distances(distinct, orders)
    found = {m: thresholds(shares[m], [b - a for a, b in spans_of(m)], rows, radius, _lead(rows, chunk_rows)) for m in orders}
    best = min(found, key=lambda m: (found[m][0], m), default=None)
    if best is None or not found[best][1]:
        raise ValueError(f"no thresholds for radius {radius}")
    return Plan(orders[best], spans_of(best), found[best][1])


def arrange(distinct: DataFrame, order: list[int]) -> DataFrame:
    """distinct with its bits in the given order."""

    def start():
        def step(batch):
            b = np.packbits(_bits(batch)[:, order], axis=1)
            s = b.reshape(-1).view(">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["id", "s0", "s1"])

        return step

    return map_arrow(distinct.select("id", "s0", "s1"), "id bigint, s0 bigint, s1 bigint", start)


def group_value(s0: np.ndarray, s1: np.ndarray, a: int, b: int) -> np.ndarray:
    """The bits [a, b), fewer than 63, as a number."""
    s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
    shift = lambda x, n: x >> np.uint64(n) if n >= 0 else x << np.uint64(-n)
    high = shift(s0, 64 - b) if a < 64 else np.zeros(len(s0), np.uint64)
    low = shift(s1, 128 - b) if b > 64 else np.zeros(len(s0), np.uint64)
    return ((high | low) & np.uint64((1 << (b - a)) - 1)).view(np.int64)


def _within(bits: int, radius: int) -> np.ndarray:
    """The numbers of so many bits of which at most radius are set."""
    return np.array([sum(1 << k for k in c) for r in range(min(bits, radius) + 1) for c in combinations(range(bits), r)], np.int64)


def _fold(v: np.ndarray, bits: int) -> np.ndarray:
    """v in so many bits, by exclusive or, so that the fold of v ^ f is that of v with that of f."""
    out = v & np.int64((1 << bits) - 1)
    while (v := v >> np.int64(bits)).any():
        out = out ^ (v & np.int64((1 << bits) - 1))
    return out


def join(s0: np.ndarray, s1: np.ndarray, value: np.ndarray, width: int, limit: int, asks: np.ndarray | None, radius: int) -> np.ndarray:
    """For each row the least place of those that it is linked with.

    value is the group's value in width bits; rows whose values differ in at most limit bits are compared. asks marks the
    rows of the other chunk, which are compared with all that aren't so marked; None compares all with all. Rows that are
    already linked, as those of a bucket are by way of its first one, aren't compared again, so that a large group of
    copies costs no more than its size.
    """
    n = len(value)
    asked = np.zeros(n, bool) if asks is None else asks
    m = n - int(asked.sum())
    labels = np.arange(n)
    if not m or not n - m and asks is not None:
        return labels
    bits = max(1, min(width, m.bit_length() + 2))
    h = _fold(value, bits)
    order = np.lexsort((h, asked))  # members first, by bucket
    s0, s1, h = s0.view(np.uint64)[order], s1.view(np.uint64)[order], h[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(h[:m], minlength=1 << bits))])

    def near(a, b):
        at = np.flatnonzero(np.bitwise_count(s0[a] ^ s0[b]) <= radius)
        a, b = a[at], b[at]
        at = np.flatnonzero(np.bitwise_count(s0[a] ^ s0[b]) + np.bitwise_count(s1[a] ^ s1[b]) <= radius)
        return a[at], b[at]

    some = np.flatnonzero(first[h + 1] > first[h])
    merge(labels, *near(some, first[h[some]]))
    # Within a bucket, members that are linked lie side by side.
    again = np.lexsort((labels[:m], h[:m]))
    back = np.concatenate([again, np.arange(m, n)])
    order, s0, s1, h = order[back], s0[back], s1[back], h[back]
    known = labels[back]
    places = np.full(n, n)
    np.minimum.at(places, known, np.arange(n))
    labels = places[known]
    sorted_by = h[:m] * np.int64(n) + known[:m]
    asking = np.arange(n) if asks is None else np.arange(m, n)
    counting = np.arange(_BLOCK, dtype=np.int32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size_held = 0
    for flip in np.unique(_fold(_within(width, limit), bits)):
        there = h[asking] ^ flip
        lo, hi = first[there], first[there + 1]
        if asks is None:
            lo = np.maximum(lo, asking + 1)  # a row is compared with later ones
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        row, lo, hi = asking[some], lo[some], hi[some]
        wide = np.flatnonzero(hi - lo > 64)
        if len(wide):  # those that are linked with the row are left out
            own = there[some[wide]] * np.int64(n) + known[row[wide]]
            end = hi[wide]
            hi[wide] = np.clip(np.searchsorted(sorted_by, own), lo[wide], end)
            rest = np.clip(np.searchsorted(sorted_by, own, side="right"), lo[wide], end)
            row, lo, hi = np.r_[row, row[wide]], np.r_[lo, rest], np.r_[hi, end]
        size = hi - lo
        ends = np.cumsum(size)
        at = 0
        while at < len(row):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + _BLOCK, side="right")))
            k = size[at:to]
            b = np.repeat((lo[at:to] - (np.cumsum(k) - k)).astype(np.int32), k)
            b += counting[: len(b)] if len(b) <= _BLOCK else np.arange(len(b), dtype=np.int32)
            # The first half of the bits tells nearly all pairs apart.
            close = np.flatnonzero(np.bitwise_count(np.repeat(s0[row[at:to]], k) ^ s0[b]) <= radius)
            a, b = np.repeat(row[at:to], k)[close], b[close]
            differ = labels[a] != labels[b]
            a, b = near(a[differ], b[differ])
            if len(a):
                held.append((a, b))
                size_held += len(a)
                if size_held > 1 << 16:
                    merge(labels, *map(np.concatenate, zip(*held)))
                    held, size_held = [], 0
            at = to
    if held:
        merge(labels, *map(np.concatenate, zip(*held)))
    places = np.full(n, n)
    np.minimum.at(places, labels, order)
    out = np.empty(n, np.int64)
    out[order] = places[labels]
    return out


def links(arranged: DataFrame, plan: Plan, radius: int, rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(a, b) such that the components of these links are those of all pairs of at most radius differing bits.

    A group's signatures are cut into chunks by the leading bits of its value, and chunks that hold more than twice their
    share into tiles. A task compares two tiles whose chunks' leading bits are near enough, or one with itself, so that
    what it holds doesn't grow with the table; a signature goes to each task of its tile.
    """
    spans, limits = plan.spans, plan.limits
    lead = [min(_lead(rows, chunk_rows), b - a) for a, b in spans]
    chunk_of = lambda s0, s1, g: group_value(s0, s1, *spans[g]) >> np.int64(spans[g][1] - spans[g][0] - lead[g])
    searched = [g for g, t in enumerate(limits) if t >= 0]
    cuts: dict[tuple[int, int], int] = {}
    if any(lead):

        def start_counts():
            def step(batch):
                s0, s1 = batch.column("s0").to_numpy(), batch.column("s1").to_numpy()
                for g in searched:
                    chunk, n = np.unique(chunk_of(s0, s1, g), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chunk), g, np.int32)), pa.array(chunk), pa.array(n)], names=["g", "chunk", "n"])

            return step

        sizes = map_arrow(arranged.select("s0", "s1"), "g int, chunk bigint, n bigint", start_counts).groupBy("g", "chunk").agg(F.sum("n").alias("n"))
        # No more rows than half as many as there are chunks
        cuts = {(g, c): math.ceil(n / chunk_rows) for g, c, n in sizes.where(F.col("n") > 2 * chunk_rows).collect()}
    names = ["g", "lo", "hi", "i", "j", "asks", "id", "s0", "s1"]

    def start():
        def step(batch):
            ids, s0, s1 = batch.column("id").to_numpy(), batch.column("s0").to_numpy(), batch.column("s1").to_numpy()
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)

            def out(g, at, lo, hi, i, j, asks):
                full = lambda x, kind: pa.array(np.broadcast_to(x, len(at)).astype(kind))
                return pa.RecordBatch.from_arrays([full(g, np.int32), full(lo, np.int64), full(hi, np.int64), full(i, np.int32), full(j, np.int32), pa.array(np.broadcast_to(asks, len(at)).astype(bool)), pa.array(ids[at]), pa.array(s0[at]), pa.array(s1[at])], names=names)

            for g in searched:
                chunk = chunk_of(s0, s1, g)
                own = [(c, k) for (h, c), k in cuts.items() if h == g]
                tiles = np.ones(len(chunk), np.int64)
                if own:
                    c, k = map(np.array, zip(*sorted(own)))
                    at = np.minimum(np.searchsorted(c, chunk), len(c) - 1)
                    tiles = np.where(c[at] == chunk, k[at], 1)
                tile = mixed % tiles
                for flip in _within(lead[g], limits[g]):
                    other = chunk ^ flip
                    theirs = tiles
                    if flip and own:
                        at = np.minimum(np.searchsorted(c, other), len(c) - 1)
                        theirs = np.where(c[at] == other, k[at], 1)
                    elif flip:
                        theirs = np.ones(len(chunk), np.int64)
                    for j in range(int(theirs.max()) if len(theirs) else 0):
                        at = np.flatnonzero(theirs > j)
                        t, x, y = tile[at], chunk[at], other[at]
                        if flip:
                            low = x < y
                            yield out(g, at, np.minimum(x, y), np.maximum(x, y), np.where(low, t, j), np.where(low, j, t), ~low)
                        else:
                            yield out(g, at, x, x, np.minimum(t, j), np.maximum(t, j), t > j)

        return step

    def compare(table: pa.Table) -> pa.Table:
        g, lo, hi, i, j = (table.column(c)[0].as_py() for c in names[:5])
        ids, s0, s1, asks = (table.column(c).to_numpy() for c in ("id", "s0", "s1", "asks"))
        order = np.argsort(ids, kind="stable")
        ids, s0, s1, asks = ids[order], s0[order], s1[order], asks[order]
        a, b = spans[g]
        width = b - a - lead[g]
        value = group_value(s0, s1, a, b) & np.int64((1 << width) - 1)
        apart = (lo ^ hi).bit_count()
        labels = join(s0, s1, value, width, limits[g] - apart, None if (lo, i) == (hi, j) else asks, radius)
        joined = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[joined], pa.int64()), "b": pa.array(ids[labels[joined]], pa.int64())})

    met = map_arrow(arranged, "g int, lo bigint, hi bigint, i int, j int, asks boolean, id bigint, s0 bigint, s1 bigint", start)
    return met.groupBy(*names[:5]).applyInArrow(compare, "a bigint, b bigint")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(id, k0, k1, m, group, text, first): a row for the rows of the same id and text, of which there are m.

    group is the least row of the group, text whether there is one, first whether the row is its group's least.
    """
    signed = signatures(docs, id_col=id_col, text_col=text_col)
    own = cut(signed.groupBy("id", "k0", "k1", "s0", "s1").agg(F.count(F.lit(1)).alias("m")).withColumn("text", F.col("s0").isNotNull()))
    row = F.struct(F.col("id").isNull().alias("void"), "id", "k0", "k1")
    distinct = cut(own.where("text").groupBy("s0", "s1").agg(F.min(row).alias("least")).select(F.monotonically_increasing_id().alias("id"), "s0", "s1", "least"))
    rows = distinct.count()
    by = plan(distinct, rows, radius)
    roots = components(links(cut(arrange(distinct, by.order)), by, radius, rows))
    placed = cut(distinct.join(roots, distinct["id"] == roots["node"], "left").select("s0", "s1", "least", F.coalesce("root", "id").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("least").alias("group")))
    groups = cut(placed.join(least, "root").select("s0", "s1", "group"))
    found = own.where("text").join(groups, ["s0", "s1"]).select(*own.columns, "group")
    every = found.unionByName(own.where("not text").withColumn("group", row))
    same = F.col("group.id").eqNullSafe(F.col("id")) & (F.col("group.k0") == F.col("k0")) & (F.col("group.k1") == F.col("k1"))
    return cut(every.select("id", "k0", "k1", "m", "group", "text", same.alias("first")))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 18) -> DataFrame:
    """(id, group_id, keep) for each row of docs; other columns are not looked at.

    Documents whose signatures differ in at most radius bits are linked, and linked documents form a group, whose
    group_id is its least id; keep marks that document, one of those of that id. A document without copies is its own group.
    Copies of a text, empty ones included, have the same signature; words are compared in lower case. Null texts are never
    copies, and all kept. Of repeated rows one is kept. A null id counts as larger than others; a group of null ids alone has
    a null group_id. Ids must be integers. Texts count as a whole. An empty table gives an empty result.
    """
    own = _grouped(docs, id_col, text_col, radius)
    each = own.select("id", "group", "first", "text", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("copy"))
    kind = docs.schema[id_col].dataType
    keep = F.col("first") & ((F.col("copy") == 1) | ~F.col("text"))
    return each.select(F.col("id").cast(kind).alias(id_col), F.col("group.id").cast(kind).alias("group_id"), keep.alias("keep"))


def unique(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 18) -> DataFrame:
    """The rows of docs, with all columns, that deduplicate() keeps: one of each group, and all with a null text.

    Of rows that repeat in id and text any one stays. Rows move once, by hashes of id and text; repeats are folded before.
    """
    own = _grouped(docs, id_col, text_col, radius).where("text")
    dropped = own.where("not first").select("k0", "k1")
    repeated = own.where("first and m > 1").select("k0", "k1")
    key = [row_key(F.col(id_col).cast("bigint"), text_col, seed=seed).alias(f"k{seed - 1}") for seed in (1, 2)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    out = rows.join(dropped.unionByName(repeated), ["k0", "k1"], "left_anti").select("row.*")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.first("row").alias("row")).select("row.*"))
    return out
