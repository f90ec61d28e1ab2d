import random

import numpy as np
import pytest
from fixtures import documents, edge_rows, groups, prose

from conftest import SF
from vecloom.llm import simhash
from vecloom.llm.components import components
from vecloom.llm.queries import QUERIES


def brute(rows, radius=18):
    """The least id of each row's group."""
    sign = simhash.Signer()
    signed = [(i, np.unpackbits(np.frombuffer(sign(t), np.uint8))) for i, t in rows]
    bits = np.array([s for _, s in signed], int)
    apart = bits.sum(1)[:, None] + bits.sum(1) - 2 * bits @ bits.T
    order = np.argsort([i for i, _ in signed], kind="stable")
    g = groups(len(rows), zip(*np.nonzero(apart[np.ix_(order, order)] <= radius)))
    return {signed[order[k]][0]: signed[order[g[k]]][0] for k in range(len(rows))}


def copies(n):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        words = t.split()
        for _ in range(rng.randint(1, 4)):
            w = list(words)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "zebra", "quartz"])
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


def test_simhash_is_brute_force(spark):
    rows = copies(150)
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.group_id for r in got} == want and len(got) == len(rows)
    assert all(r.keep == (r.doc_id == r.group_id) for r in got) and 0 < sum(not r.keep for r in got)


def test_chunks_do_not_matter(spark):
    """Chunks and tiles of a few rows give the links of one."""
    rows = copies(150)
    signed = simhash.signatures(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("s0", "s1").agg({"id": "min"}).toDF("s0", "s1", "id").cache()
    n = signed.count()
    found = []
    for radius in (18, 25):
        by = simhash.plan(signed, n, radius)
        assert sorted(by.order) == list(range(128)) and sum(by.limits) == radius - len(by.spans) + 1
        arranged = simhash.arrange(signed, by.order).cache()
        for chunk in (1 << 19, 20, 5):
            found.append(sorted((r.node, r.root) for r in components(simhash.links(arranged, by, radius, n, chunk)).collect()))
    assert found[0] == found[1] == found[2] and found[3] == found[4] == found[5] and found[0] != found[3]


def test_more_signatures_have_wider_groups(spark):
    rng = np.random.default_rng(2)
    s = rng.integers(-(2**63), 2**63 - 1, size=(4000, 2))
    df = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(s)], "id bigint, s0 bigint, s1 bigint")
    few, many = simhash.plan(df, 4000, 18), simhash.plan(df, 4_000_000, 18)
    assert len(many.spans) < len(few.spans)


def test_pair_distances(spark):
    rng = np.random.default_rng(2)
    s = rng.integers(-(2**63), 2**63 - 1, size=(300, 2))
    df = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(s)], "id bigint, s0 bigint, s1 bigint").coalesce(1)
    order = rng.permutation(128).tolist()
    got = simhash.pair_distances(df, {8: order})[8]
    bits = np.unpackbits(s.astype(">i8").view(np.uint8).reshape(300, 16), axis=1)[:, order]
    shifts = np.unique(np.linspace(1, 299, 8).astype(int))
    for g, (a, b) in enumerate(simhash.spans_of(8)):
        apart = np.concatenate([(bits[:, a:b] ^ np.roll(bits, k, axis=0)[:, a:b]).sum(1) for k in shifts])
        assert np.allclose(got[g, :17], np.bincount(apart, minlength=17) / len(apart))


@pytest.mark.parametrize("two", [False, True])
def test_join_is_brute_force(two):
    """Signatures in tight groups, which are linked by way of one, and loose ones."""
    rng = np.random.default_rng(4)
    n = 900
    bits = rng.integers(0, 2, size=(n, 128)).astype(np.uint8)
    for k in range(n // 2):
        bits[k] = bits[n // 2 + k % 3]
        bits[k, rng.integers(0, 128, rng.integers(0, 14))] ^= 1
    s = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    asks = rng.random(n) < 0.5 if two else None
    apart = (bits[:, None] != bits).sum(2)
    close = (bits[:, None, 20:36] != bits[:, 20:36]).sum(2) <= 2
    pairs = (apart <= 18) & close & (asks[:, None] != asks if two else True)
    got = simhash.join(s[:, 0].copy(), s[:, 1].copy(), simhash.group_value(s[:, 0].copy(), s[:, 1].copy(), 20, 36), 16, 2, asks, 18)
    want = groups(n, zip(*np.nonzero(pairs)))
    # By way of a bucket's first row more true pairs may be linked, but never others.
    every = groups(n, zip(*np.nonzero(apart <= 18)))
    for k in range(n):
        assert got[k] == got[want[k]] and every[k] == every[got[k]] and got[k] <= k


def test_group_values():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, size=(50, 128)).astype(np.uint8)
    s = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    for a, b in ((0, 16), (50, 77), (60, 64), (64, 90), (110, 128)):
        want = [int("".join(map(str, r)), 2) for r in bits[:, a:b]]
        assert simhash.group_value(s[:, 0].copy(), s[:, 1].copy(), a, b).tolist() == want


def test_edges(spark):
    rows = edge_rows()
    got = simhash.deduplicate(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.group_id, r.keep))
    assert sorted(by[1]) == [(1, False), (1, True)] and by[2] == [(1, False)] and by[3] == [(3, True)] and by[None] == [(None, True)] * 2
    assert len(by[10]) == 2 and (10, True) in by[10]  # two documents of one id, of which one is near another
    assert by[4] == [(4, True)] and by[5] == [(4, False)]  # a blank text is a copy of an empty one
    assert simhash.deduplicate(documents(spark, [])).count() == 0 and simhash.unique(documents(spark, [])).count() == 0
    docs = documents(spark, rows)
    kept = simhash.unique(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((r.doc_id for r in got if r.keep), key=key)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = groups(401, pairs)
    assert got == {k: int(w) for k, w in enumerate(want) if k != w}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query(spark):
    got = {r.doc_id: r.group_id for r in QUERIES["op2_simhash"](spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == brute(docs)
