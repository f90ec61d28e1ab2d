"""Language-model scores from a weighted backoff automaton over the n-grams of bytes of the whole corpus.

An n-gram is a number of 9 bits a symbol: 0 before a text begins, a byte's value plus 1 within it. Probabilities are
interpolated Witten-Bell ones: with c kept occurrences of w after context h, C of all and T kinds of symbols after h,

    P(w | h) = (c + T * P(w | h without its first symbol)) / (C + T),

down to a uniform share of 1/256. Kept are n-grams whose count reaches the cutoff of their order.

Texts lie in parts of bounded size. Each part's n-grams meet their counts in the whole corpus, and a worker builds the
automaton of those that its part needs and sends the part's texts through it. So a worker holds what its texts can use,
whatever the size of the model, and there is one way for all sizes.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import map_arrow, shared_dir, slices

ORDER = 5
CUTOFFS = (1, 1, 1, 2, 2)
#: Bytes of text of a part; a longer text is a part for itself.
PART_BYTES = 24 << 20
_KEY = 9 * ORDER
_HELD = 12_000_000
_LANE = 512


def mask(k: int) -> int:
    return (1 << 9 * k) - 1


def symbols(texts: list[str]) -> np.ndarray:
    """The symbols of all texts, each after ORDER - 1 zeros."""
    pad = b"\0" * (ORDER - 1)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    s = np.frombuffer(pad + pad.join(data), np.uint8).astype(np.int64) + 1
    starts = np.cumsum([0, *(len(d) + ORDER - 1 for d in data[:-1])])
    for k in range(ORDER - 1):
        s[starts + k] = 0
    return s


def grams(s: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol of s that isn't 0."""
    key = s[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        key |= s[ORDER - 1 - k : len(s) - k] << np.int64(9 * k)
    return key[s[ORDER - 1 :] != 0]


def parted(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """(part, id, text) of each row, written to the shared folder: parts are given once."""
    schema = f"part bigint, id {docs.schema[id_col].dataType.simpleString()}, text string"

    def start():
        state = [TaskContext.get().partitionId() << 32, 0]

        def step(batch):
            for piece in slices(batch, 1, max(1, part_bytes // 8)):
                size = piece.column(1).nbytes
                if state[1] and state[1] + size > part_bytes:
                    state[:] = state[0] + 1, 0
                state[1] += size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(piece.num_rows, state[0])), *piece.columns], names=["part", "id", "text"])

        return step

    where = f"{shared_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    map_arrow(docs.select(id_col, text_col), schema, start).write.parquet(where)
    return docs.sparkSession.read.parquet(where)


def count_grams(texts: DataFrame) -> DataFrame:
    """(part, code, n): each n-gram of each part, of all orders; its code is order << _KEY | n-gram. Some come in several rows."""

    def run(batches):
        held: dict[int, list] = {}

        def added(keys, counts):
            k, n = np.concatenate(keys), np.concatenate(counts)
            by = np.argsort(k, kind="stable")
            k, n = k[by], n[by]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            return k[first], np.add.reduceat(n, first)

        def out(part):
            k, n = added(*zip(*held.pop(part)))
            for order in range(ORDER, 0, -1):
                if order < ORDER:
                    k, n = added([k & mask(order)], [n])
                for at in range(0, len(k), 1 << 18):
                    own = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[own]), part)), pa.array(k[own] | np.int64(order << _KEY)), pa.array(n[own])], names=["part", "code", "n"])

        for batch in batches:
            for piece in slices(batch, 1, 4 << 20):
                parts = piece.column(0).to_numpy()
                for part in np.unique(parts):
                    own = [t for t in piece.filter(pa.array(parts == part)).column(1).to_pylist() if t]
                    if own:
                        k = np.sort(grams(symbols(own)))
                        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                        held.setdefault(int(part), []).append((k[first], np.diff(np.r_[first, len(k)])))
                if sum(len(k) for pieces in held.values() for k, _ in pieces) > _HELD:
                    for part in list(held):
                        yield from out(part)
        for part in list(held):
            yield from out(part)

    return texts.select("part", "text").mapInArrow(run, "part bigint, code bigint, n bigint")


def model(counted: DataFrame, cutoffs) -> DataFrame:
    """(code, c, total, kinds) of all n-grams after whose context there is a kept one.

    c is the count, 0 for one that isn't kept; total and kinds are of the kept ones after the context.
    """
    sums = counted.groupBy("code").agg(F.sum("n").alias("c"))
    least = F.element_at(F.array(*map(F.lit, cutoffs)), F.shiftright("code", _KEY).cast("int"))
    sums = sums.withColumn("c", F.when(F.col("c") >= least, F.col("c")).otherwise(F.lit(0)))
    context = Window.partitionBy(F.shiftright("code", 9))  # at most 256 rows: an order and a context
    own = sums.withColumns({"total": F.sum("c").over(context), "kinds": F.count(F.when(F.col("c") > 0, True)).over(context)})
    return own.where("total > 0")


@dataclass
class Automaton:
    """States are contexts; an arc (state, symbol) has a next state and a log-probability, a failure arc a weight.

    Arcs lie in an open-addressed table of slots.
    """

    keys: np.ndarray
    nexts: np.ndarray
    logp: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray
    start: int
    root: int
    unseen: float

    @classmethod
    def build(cls, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Automaton:
        """Of n-grams of each order: keys in order, counts (0 for one that isn't kept), and total and kinds as model() has them.

        With an n-gram there must be its endings.
        """
        contexts, spans, offset = [], [], []
        for k, (keys, *_) in enumerate(orders):
            ctx = keys >> 9
            first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(keys) else np.zeros(0, np.int64)
            contexts.append(ctx[first])
            spans.append(first)
            offset.append(sum(map(len, contexts[:-1])))
        if not len(contexts[0]):  # no text at all: one state, no arcs
            return cls(np.full(2, -1), np.zeros(2, np.int32), np.zeros(2), np.zeros(1, np.int32), np.zeros(1), 0, 0, -math.log(256))
        states = sum(map(len, contexts))
        fail, backoff = np.zeros(states, np.int32), np.zeros(states)

        def state(length: np.ndarray | int, ctx: np.ndarray) -> np.ndarray:
            """The longest state that is a suffix of the context, of up to length symbols."""
            found = np.full(len(ctx), -1)
            for j in range(length, -1, -1):
                todo = np.flatnonzero(found < 0)
                if not len(todo):
                    break
                c = ctx[todo] & mask(j)
                at = np.minimum(np.searchsorted(contexts[j], c), max(len(contexts[j]) - 1, 0))
                hit = contexts[j][at] == c if len(contexts[j]) else np.zeros(len(c), bool)
                found[todo[hit]] = offset[j] + at[hit]
            return found

        arcs, nexts, probs = [], [], []
        below_keys, below_p = None, None
        for k, (keys, n, total, kinds) in enumerate(orders):
            if not len(keys):
                below_keys, below_p = keys, np.zeros(0)
                continue
            total, kinds = total.astype(float), kinds.astype(float)
            own = offset[k] + np.arange(len(contexts[k]))
            backoff[own] = np.log(kinds / (total + kinds))[spans[k]]
            fail[own] = state(k - 1, contexts[k]) if k else 0
            of = np.repeat(own, np.diff(np.r_[spans[k], len(keys)]))
            kept = n > 0
            keys, n, total, kinds, of = keys[kept], n[kept], total[kept], kinds[kept], of[kept]
            lower = np.full(len(keys), 1 / 256) if k == 0 else below_p[np.searchsorted(below_keys, keys & mask(k))]
            p = (n + kinds * lower) / (total + kinds)
            arcs.append(of * 512 + (keys & 511))
            nexts.append(state(min(k + 1, ORDER - 1), keys))
            probs.append(np.log(p))
            below_keys, below_p = keys, p
        arcs, nexts, probs = np.concatenate(arcs), np.concatenate(nexts), np.concatenate(probs)
        size = 1 << max(4, int(2 * len(arcs) - 1).bit_length())
        table = np.full(size, -1, np.int64)
        place = np.zeros(len(arcs), np.int64)
        todo, slot = np.arange(len(arcs)), _slot(arcs, size)
        while len(todo):
            free = table[slot] < 0
            table[slot[free]] = arcs[todo[free]]  # of several, one wins
            won = table[slot] == arcs[todo]
            place[todo[won]] = slot[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)
        out_next, out_p = np.zeros(size, np.int32), np.zeros(size)
        out_next[place], out_p[place] = nexts, probs
        unseen = float(backoff[0] - math.log(256))
        return cls(table, out_next, out_p, fail, backoff, int(state(ORDER - 1, np.zeros(1, np.int64))[0]), 0, unseen)

    def step(self, now: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after the symbol and its log-probability, for many states at once."""
        out, logp = np.zeros(len(now), np.int32), np.zeros(len(now))
        todo, at, sym = None, now, symbol
        size = len(self.keys)
        while True:
            arc = at.astype(np.int64) * 512 + sym
            slot = _slot(arc, size)
            there = self.keys[slot]
            look = np.flatnonzero((there != arc) & (there >= 0))
            while len(look):
                slot[look] = (slot[look] + 1) & (size - 1)
                there[look] = self.keys[slot[look]]
                look = look[(there[look] != arc[look]) & (there[look] >= 0)]
            hit = there == arc
            if todo is None:
                if hit.all():
                    return self.nexts[slot], self.logp[slot]
                out[:], logp[:] = np.where(hit, self.nexts[slot], 0), np.where(hit, self.logp[slot], 0)
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = self.nexts[slot[hit]]
                logp[todo[hit]] += self.logp[slot[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out, logp
            at, sym = at[~hit], sym[~hit]
            root = at == self.root
            if root.any():  # a byte that the corpus doesn't have
                logp[todo[root]] += self.unseen
                out[todo[root]] = self.root
                todo, at, sym = todo[~root], at[~root], sym[~root]
                if not len(todo):
                    return out, logp
            logp[todo] += self.backoff[at]
            at = self.fail[at]

    def score(self, texts: list[str]) -> np.ndarray:
        """The log-probability of each text, as a whole.

        Texts go through the automaton side by side, long ones in lanes of _LANE symbols; a lane that begins within a text
        first reads the ORDER - 1 symbols before it, after which its state is that of one long traversal.
        """
        s = symbols(texts)
        size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts])
        begin = np.cumsum(np.r_[0, size[:-1] + ORDER - 1]) + ORDER - 1
        lanes = -(-size // _LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[text] + number * _LANE
        length = np.minimum(_LANE, size[text] - number * _LANE)
        order = np.argsort(-length, kind="stable")
        text, number, at, length = text[order], number[order], at[order], length[order]
        now = np.where(number == 0, self.start, self.root).astype(np.int32)
        inner = np.flatnonzero(number > 0)
        if len(inner):
            for k in range(ORDER - 1):
                now[inner], _ = self.step(now[inner], s[at[inner] - (ORDER - 1) + k])
        total = np.zeros(len(text))
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for t, n in enumerate(active):
            now[:n], logp = self.step(now[:n], s[at[:n] + t])
            total[:n] += logp
        out = np.zeros(len(texts))
        np.add.at(out, text, total)
        return out


def _slot(arc: np.ndarray, size: int) -> np.ndarray:
    h = arc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - size.bit_length() + 1)).view(np.int64)


def automaton(rows: pa.Table) -> Automaton:
    """Of (code, c, total, kinds)."""
    code, c, total, kinds = (rows.column(x).to_numpy() for x in ("code", "c", "total", "kinds"))
    by = np.argsort(code)
    code, c, total, kinds = code[by], c[by], total[by], kinds[by]
    once = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else by
    code, c, total, kinds = code[once], c[once], total[once], kinds[once]
    ends = np.searchsorted(code, np.arange(1, ORDER + 2, dtype=np.int64) << _KEY)
    return Automaton.build([(code[a:b] & np.int64((1 << _KEY) - 1), c[a:b], total[a:b], kinds[a:b]) for a, b in zip(ends[:-1], ends[1:])])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cutoffs=CUTOFFS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_bytes, avg_logprob): the mean natural log-probability of a byte, for each row of docs, as a whole.

    The model is of all texts of docs. cutoffs, one for each order, must not fall from one order to the next. A null text
    has nulls, an empty one 0 bytes and a null mean. Repeated rows count each time in the model and give repeated results.
    An empty table gives an empty result. Other columns are not looked at.
    """
    if len(cutoffs) != ORDER or list(cutoffs) != sorted(cutoffs):
        raise ValueError(f"cutoffs must be {ORDER} numbers in order")
    texts = parted(docs, id_col, text_col, part_bytes)
    counted = count_grams(texts)
    needed = counted.join(model(counted, cutoffs), "code").select("part", "code", "c", "total", "kinds")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, avg_logprob double"

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        ids, texts = rows.column("id"), rows.column("text").to_pylist()
        some = [k for k, t in enumerate(texts) if t]
        sizes = np.array([0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        mean = np.zeros(len(texts))
        if some:
            machine = automaton(own)
            for a in range(0, len(some), 1 << 12):
                part = some[a : a + (1 << 12)]
                mean[part] = np.round(machine.score([texts[k] for k in part]) / sizes[part], 6)
        null = np.array([t is None for t in texts], bool)
        return pa.Table.from_arrays([ids, pa.array(sizes, mask=null), pa.array(mean, mask=sizes == 0)], names=[id_col, "n_bytes", "avg_logprob"])

    return needed.groupBy("part").cogroup(texts.groupBy("part")).applyInArrow(run, schema)


def _order_sql(k: int) -> str:
    return f"""k{k} AS (SELECT substr(g, {2 * (ORDER - k) + 1}) AS g, sum(n) AS n FROM t GROUP BY 1 HAVING sum(n) >= {CUTOFFS[k - 1]}),
h{k} AS (SELECT substr(g, 1, {2 * (k - 1)}) AS h, sum(n) AS c, count(*) AS t FROM k{k} GROUP BY 1),
p{k} AS (SELECT p.g, CASE WHEN h.c IS NULL THEN p.p ELSE (coalesce(o.n, 0) + h.t * p.p) / (h.c + h.t)::DOUBLE END AS p
  FROM p{k - 1} p LEFT JOIN k{k} o ON o.g = substr(p.g, {2 * (ORDER - k) + 1}) LEFT JOIN h{k} h ON h.h = substr(p.g, {2 * (ORDER - k) + 1}, {2 * (k - 1)}))"""


SQL = f"""
WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n, '{"__" * (ORDER - 1)}' || hex(encode(text)) AS h FROM documents),
own AS (SELECT doc_id, unnest(list_transform(range(n), lambda i: substr(h, 2 * i + 1, {2 * ORDER}))) AS g FROM d WHERE n > 0),
g AS (SELECT doc_id, g, count(*) AS n FROM own GROUP BY ALL),
t AS (SELECT g, sum(n) AS n FROM g GROUP BY g),
p0 AS (SELECT g, 1 / 256::DOUBLE AS p FROM t),
{", ".join(map(_order_sql, range(1, ORDER + 1)))},
s AS (SELECT doc_id, sum(g.n * ln(p)) AS s FROM g JOIN p{ORDER} USING (g) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, round(s / n, 6) AS avg_logprob FROM d LEFT JOIN s USING (doc_id)
"""
