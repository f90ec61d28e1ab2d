import duckdb
import numpy as np
import pytest
from fixtures import groups

from conftest import SF
from vecloom.llm import ann, embedding_dedup, vectors
from vecloom.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, id bigint, v string, u int, h int, dim int, l int, tree int, role int, a int, b int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 1, 1, 1, 1, 1, 1, 1, 1) for i, v in rows], SCHEMA)


def planted(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 3):
        x[k] = x[n // 3 + k % 40] + rng.normal(size=dim) * rng.uniform(0.02, 0.4)
    x[5:9] = x[4] * 3  # copies but for their length
    return x.astype(np.float32)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("n,dim,width,leaf,compared", [(400, 20, 6, 40, 1 << 15), (400, 20, 6, 60, 32), (150, 3, 8, 1 << 13, 1 << 15), (300, 64, 8, 50, 64)])
def test_dedup_is_brute_force(spark, monkeypatch, n, dim, width, leaf, compared):
    monkeypatch.setattr(embedding_dedup, "_COMPARED", compared)
    x = planted(n, dim)
    least = 0.95
    want = groups(n, zip(*np.nonzero(cosines(x) >= least)))
    got = embedding_dedup.deduplicate(frame(spark, enumerate(x)), least_cosine=least, block_dims=width, leaf_rows=leaf).toPandas().sort_values("vec_id")
    assert got.group_id.tolist() == want.tolist()
    assert (got.keep == (got.vec_id == got.group_id)).all() and 10 < got.keep.sum() < n


def test_dedup_thresholds(spark):
    x = planted(200, 12, 3)
    for least in (0.5, 0.999, 1.0):
        got = embedding_dedup.deduplicate(frame(spark, enumerate(x)), least_cosine=least, leaf_rows=30).toPandas().sort_values("vec_id")
        near = cosines(x) >= least
        if least == 1.0:
            assert got.keep.sum() >= 190  # rounding may part some copies, but nothing else is linked
        else:
            assert got.group_id.tolist() == groups(200, zip(*np.nonzero(near))).tolist()
    with pytest.raises(ValueError):
        embedding_dedup.deduplicate(frame(spark, []), least_cosine=0)


EDGES = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, None), (4, []), (5, [0, 0]), (6, [1, None]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (None, [1, 0]), (9, [1, 0, 0]), (10, [0, 1]), (11, [1, 0.01]), (12, [1e-30, 0]), (13, [-1, 0])]


def test_dedup_edges(spark):
    got = sorted((r.vec_id or 0, r.group_id, r.keep) for r in embedding_dedup.deduplicate(frame(spark, EDGES)).collect())
    ones = {2, 11, 12}
    want = sorted((i or 0, 1 if i in ones | {1} else i, i is None or i not in ones) for i, _ in EDGES)
    assert got == want
    assert embedding_dedup.deduplicate(frame(spark, [])).count() == 0
    assert embedding_dedup.deduplicate(frame(spark, [(3, None)])).collect()[0][:] == (3, 3, True)


def test_ann_edges(spark):
    got = {}
    for r in ann.neighbours(frame(spark, EDGES), k=3, every=1).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour, r.similarity)
    assert set(got) == {1, 2, 10, 11, 12, 13}
    assert got[1] == {1: (2, 1.0), 2: (12, 1.0), 3: (11, 0.99995)} and got[13][1] == (10, 0.0)
    assert {r.vec_id for r in ann.neighbours(frame(spark, EDGES), k=3, every=5).collect()} == {10}
    assert ann.neighbours(frame(spark, [])).count() == 0 and ann.neighbours(frame(spark, [(1, [1, 2])]), every=1).count() == 0


def recall(spark, x, **options):
    s = cosines(x)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :10]
    rows = ann.neighbours(frame(spark, enumerate(x)), every=1, **options).collect()
    got = [set() for _ in x]
    for r in rows:
        assert r.vec_id != r.neighbour and abs(r.similarity - s[r.vec_id, r.neighbour]) < 1e-5
        got[r.vec_id].add(r.neighbour)
    assert all(len(g) == 10 for g in got) and len(rows) == 10 * len(x)
    return np.mean([len(g & set(w)) / 10 for g, w in zip(got, want)])


@pytest.mark.parametrize("options", [{}, {"cell_rows": 64}])
def test_ann_recall(spark, options):
    rng = np.random.default_rng(1)
    assert recall(spark, rng.normal(size=(1500, 32)).astype(np.float32), **options) >= 0.9
    centres = rng.normal(size=(30, 32))
    assert recall(spark, (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 32))).astype(np.float32), **options) >= 0.9


def test_ann_many_copies(spark):
    """Of a thousand equal rows the least ids are the answers."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1400, 16)).astype(np.float32)
    x[200:1200] = x[200]
    got = {}
    for r in ann.neighbours(frame(spark, enumerate(x)), every=100).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert set(got) == set(range(0, 1400, 100))
    for q in range(200, 1200, 100):
        assert got[q] == [i for i in range(200, 212) if i != q][:10]


def test_prefix_lengths():
    lengths = ann._lengths(np.array([0.0, 0.5, 0.99, 1.0]), 24, 0.9)
    assert lengths.min() > 0  # no root
    p = 1 - np.arccos(0.5) / np.pi
    used = lengths[1]
    assert np.prod(1 - p**used) <= 0.1 and np.prod(1 - p ** (used + 1)) > 0.1 and used.max() - used.min() <= 1
    assert lengths[3].tolist() == [ann.BITS] * 24


def test_small_vectors():
    """What rounding takes is within the stated bound."""
    rng = np.random.default_rng(2)
    u = vectors.unit(rng.normal(size=(200, 24)))
    q, scale, lost = vectors.small(u)
    r = vectors.restored(q, scale)
    assert (np.abs(r @ r.T - u @ u.T) <= vectors.unsure(lost[:, None], lost)).all() and lost.max() < 0.05


def test_queries(spark):
    got = QUERIES["op1_embedding_dedup"](spark, SF).toPandas().sort_values("vec_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLES["op1_embedding_dedup"]).df().sort_values("vec_id")
    assert got.astype(str).values.tolist() == want[list(got.columns)].astype(str).values.tolist()
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], np.float32)
    s = cosines(x)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :10]
    found = QUERIES["op7_ann"](spark, SF).collect()
    assert {r.vec_id for r in found} == set(range(0, len(x), 100)) and len(found) == 10 * len({r.vec_id for r in found})
    assert sum(r.neighbour in want[r.vec_id] for r in found) / len(found) >= 0.9
