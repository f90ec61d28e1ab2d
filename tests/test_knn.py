import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloom.operators import knn

SCHEMA = "id bigint, v array<double>"


def rows(spark, x, ids=None, partitions=3):
    data = [(int(i), [float(a) for a in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def result(df):
    return {r.q_id: r.t for r in df.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "t_id"))), lambda x: x["t_id"]).alias("t")).collect()}


def brute(test, train, k, name):
    out = {}
    for q, a in enumerate(test):
        d = knn._exact(np.repeat(a[None], len(train), 0), train, name)
        out[q] = np.lexsort((np.arange(len(train)), d))[:k].tolist()
    return out


@pytest.mark.parametrize("name", sorted(knn.KERNEL))
def test_strategies_agree(spark, name):
    rng = np.random.default_rng(3)
    test, train = rng.normal(size=(17, 6)), rng.normal(size=(90, 6))
    train[10] = train[20]
    want = brute(test, train, 7, name)
    a, b = rows(spark, test), rows(spark, train)
    for options in ({"strategy": "kernel"}, {"strategy": "native"}, {"strategy": "kernel", "broadcast_bytes": 0, "tile_rows": 5}):
        assert result(knn.knn(a, b, vector="v", k=7, metric=name, **options)) == want, options


def test_ties_and_prefix(spark):
    train = rows(spark, [[1, 0], [1, 0], [0, 1], [5, 5]], [7, 3, 1, 2])
    test = rows(spark, [[1, 0]])
    for strategy in ("kernel", "native"):
        got = [result(knn.knn(test, train, vector="v", k=k, metric="l2", strategy=strategy))[0] for k in (1, 2, 10)]
        assert got == [[3], [3, 7], [3, 7, 1, 2]]


def test_partitions_do_not_matter(spark):
    x = np.random.default_rng(5).integers(0, 3, size=(60, 3))  # many ties
    got = [result(knn.knn(rows(spark, x, partitions=p), rows(spark, x, partitions=9 - p), vector="v", k=5)) for p in (1, 5)]
    assert got[0] == got[1]


def test_filter_self_and_strings(spark):
    x = np.eye(4)
    a = rows(spark, x)
    assert result(knn.knn(a, a, vector="v", k=1)) == {k: [k] for k in range(4)}
    assert set(sum(result(knn.knn(a, a, vector="v", k=9, where="id < 2")).values(), [])) == {0, 1}
    named = a.withColumn("id", F.concat(F.lit("k"), "id"))
    assert result(knn.knn(named, named, vector="v", k=1)) == {f"k{k}": [f"k{k}"] for k in range(4)}


def test_zero_nan_large_ids(spark):
    train = rows(spark, [[0, 0], [1, 1]], [2**60 + 1, 2**60 + 2])
    got = knn.knn(rows(spark, [[0, 0]]), train, vector="v", k=2).orderBy("rk").collect()
    assert [(r.t_id, r.distance) for r in got] == [(2**60 + 1, 1.0), (2**60 + 2, 1.0)]
    odd = rows(spark, [[float("nan"), 0], [1, 1]])
    assert result(knn.knn(rows(spark, [[1, 1]]), odd, vector="v", k=2, metric="l2"))[0] == [1, 0]


def test_empty_and_repeated(spark):
    none, some = rows(spark, []), rows(spark, [[1, 0], [0, 1]], [4, 4])
    assert knn.knn(none, some, vector="v").count() == 0
    assert [r.neighbors_id for r in knn.neighbours(some, none, vector="v").collect()] == [[], []]
    assert knn.neighbours(none, some, vector="v").count() == 0
    got = knn.neighbours(some, rows(spark, [[1, 0], [0, 1]]), vector="v", k=1).collect()
    assert sorted((r.id, r.neighbors_id) for r in got) == [(4, [0]), (4, [1])]


@pytest.mark.parametrize("bad", [[[1.0]], [None], [[1.0, None]]])
@pytest.mark.parametrize("strategy", ["kernel", "native"])
def test_bad_vectors_raise(spark, bad, strategy):
    good = rows(spark, [[1, 0], [0, 1]])
    train = spark.createDataFrame([(9, bad[0])], SCHEMA)
    with pytest.raises(PySparkException):
        knn.knn(good, train, vector="v", strategy=strategy).collect()
    with pytest.raises(ValueError):
        knn.knn(good, good, vector="v", metric="nope")
    with pytest.raises(ValueError):
        knn.knn(good, good, vector="v", k=0)


def test_merge_is_one_pass(spark):
    x = np.random.default_rng(8).normal(size=(40, 4))
    a = rows(spark, x)
    parts = [knn.knn(a, a, vector="v", k=6, where=w) for w in ("id < 13", "id >= 13")]
    assert result(knn.merged(parts, 6)) == result(knn.knn(a, a, vector="v", k=6))


def test_float32_orders_by_rounded(spark):
    train = rows(spark, [[1 + 1e-12], [1]], [1, 2])
    test = rows(spark, [[0]])
    assert result(knn.knn(test, train, vector="v", metric="l2"))[0] == [2, 1]
    assert result(knn.knn(test, train, vector="v", metric="l2", precision="float32"))[0] == [1, 2]


@pytest.mark.parametrize("name", ["canberra", "braycurtis", "minkowski", "l1", "chebyshev", "cosine", "l2", "ip"])
def test_kernel_has_metric_and_bounds_are_safe(spark, name):
    """No metric falls back to a cross join of expressions, and tiles of rows of many sizes, ties and odd values lose nothing."""
    assert name in knn.KERNEL
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 9)) * 10.0 ** rng.integers(-3, 3, size=(700, 1))
    x[50:90] = x[:40]
    x[90], x[91], x[92], x[93] = 0, 1e-40, 1e200, x[94] * (1 + 1e-9)
    a = rows(spark, x)
    with np.errstate(all="ignore"):
        want = brute(x, x, 12, name)
    assert result(knn.knn(a, a, vector="v", k=12, metric=name, strategy="kernel", tile_rows=300)) == want


def test_kernel_of_equal_rows_is_bounded():
    import pyarrow as pa

    state = knn._Nearest(np.arange(300), pa.array(range(300)), np.ones((300, 4)), 3, "l1", "double")
    for _ in range(3):
        state.add(pa.array(range(2000)), np.ones((2000, 4)))
        assert sum(len(a) for a, _, _ in state.found) <= 300 * 3 * 16
    assert [r["t_id"] for b in state.batches() for r in b.to_pylist()][:3] == [0, 0, 0]


def test_plan_of_kernel_broadcasts_nothing(spark):
    a = rows(spark, np.eye(4))
    plan = knn.knn(a, a, vector="v", k=1, metric="braycurtis")._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "MapInArrow" in plan and "BroadcastExchange" not in plan


def test_pairwise_against_expressions(spark):
    """Pairs come from tiles; near and equal rows keep their digits, and odd vectors have null distances."""
    from vecloom.functions import metrics

    x = np.random.default_rng(2).normal(size=(60, 5)) * 50
    x[7], x[8], x[9] = x[6], x[6] + 3e-6, 0
    a = rows(spark, x).union(spark.createDataFrame([(100, [1.0]), (101, None), (102, [1.0, None, 1.0, 1.0, 1.0])], SCHEMA))
    got = knn.pairwise(a, a, vector="v", pk="id", digits=6, tile_rows=16)
    b = a.select(F.col("id").alias("a_id"), F.col("v").alias("p")).crossJoin(a.select(F.col("id").alias("b_id"), F.col("v").alias("q")))
    want = b.select("a_id", "b_id", F.round(metrics.cosine("p", "q"), 6).alias("cosine"), F.round(metrics.l2("p", "q"), 6).alias("l2"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "CartesianProduct" in got._jdf.queryExecution().toString()


def _odd_rows():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 6)) * 10.0 ** rng.integers(-2, 2, size=(700, 1))
    x[50:90] = x[:40]
    x[90], x[91], x[92] = 0, 1e200, np.nan
    return x


def _native_is_limited(spark, name):
    """Few pairs leave the product, for its condition holds distances to limits; ties, odd values and repeated keys lose nothing."""
    x = _odd_rows()
    a = rows(spark, x)
    got = knn.knn(a, a, vector="v", k=12, metric=name, strategy="native")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct (isnull(limit" in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan and "InArrow" not in plan
    with np.errstate(all="ignore"):
        assert result(got) == brute(x, x, 12, name)
    one = rows(spark, x, [7] * len(x))  # no part of train can be chosen by its key
    each = [sorted((r.row, r.rk) for r in knn.knn(a, t, vector="v", k=12, metric=name, strategy="native").collect()) for t in (a, one)]
    assert each[0] == each[1] and len(each[0]) == 12 * len(x)


def test_native_cosine_is_limited(spark):
    _native_is_limited(spark, "cosine")


def test_native_l2_is_limited(spark):
    _native_is_limited(spark, "l2")


@pytest.mark.parametrize("name", ["cosine", "l2", "sqeuclidean", "ip"])
def test_native_products_compare_no_pairs_by_expressions(spark, name):
    """Where the kth neighbour is told apart in single precision, no pair meets the product of expressions."""
    x = np.random.default_rng(21).normal(size=(700, 8))
    a = rows(spark, x)
    got = knn.knn(a, a, vector="v", k=12, metric=name, strategy="native")
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    assert result(got) == brute(x, x, 12, name)


@pytest.mark.parametrize("name", ["cosine", "l2", "ip"])
def test_native_products_lose_no_near_or_equal_rows(spark, name):
    """Single precision can't tell some rows apart, others are equal, of odd size or long; both precisions."""
    x = _odd_rows()
    x[100:160] = x[99] * (1 + 1e-10 * np.arange(60)[::-1, None])  # more than are wanted, the nearest last
    x[160:220] = x[159]
    x[220] *= 1e9
    x[221] = 1e-120
    a = rows(spark, x)
    with np.errstate(all="ignore"):
        want = brute(x, x, 5, name)
    got = knn.knn(a, a, vector="v", k=5, metric=name, strategy="native")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    distances = lambda df: sorted((r.row, r.rk, r.distance) for r in df.select("row", "rk", "distance").collect())
    rounded = [distances(knn.knn(a, a, vector="v", k=5, metric=name, strategy=s, precision="float32")) for s in ("native", "kernel")]
    np.testing.assert_allclose(*[[r[2] for r in d] for d in rounded], rtol=1e-5, atol=1e-6)
    found = result(got)
    if name == "l2":
        assert found == want
    else:  # the last digits of equal distances differ by the order of sums
        for q, t in found.items():
            d = [knn._exact(x[[q] * 5], x[i], name) for i in (t, want[q])]
            np.testing.assert_allclose(*d, rtol=1e-12, atol=1e-12)


def test_native_products_fold_equal_vectors(spark):
    """More copies of each vector than are wanted don't send queries to the product of expressions; ties go by key."""
    x = np.tile(np.random.default_rng(22).normal(size=(40, 6)), (20, 1))
    a = rows(spark, x)
    got = knn.knn(a, a, vector="v", k=12, metric="l2", strategy="native")
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    assert result(got) == brute(x, x, 12, "l2")
