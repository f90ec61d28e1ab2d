import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import metrics, scalars


def test_values(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 5)), rng.normal(size=(20, 5))
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))], "k int, a array<double>, b array<double>")
    got = df.select("k", *(f("a", "b").alias(n) for n, f in metrics.METRICS.items())).orderBy("k").toPandas()
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {
        "cosine": 1 - (unit(x) * unit(y)).sum(1),
        "l2": np.linalg.norm(x - y, axis=1),
        "sqeuclidean": ((x - y) ** 2).sum(1),
        "l1": np.abs(x - y).sum(1),
        "chebyshev": np.abs(x - y).max(1),
        "ip": -(x * y).sum(1),
        "canberra": (np.abs(x - y) / (np.abs(x) + np.abs(y))).sum(1),
        "hamming": (x != y).mean(1),
        "correlation": 1 - (unit(x - x.mean(1, keepdims=True)) * unit(y - y.mean(1, keepdims=True))).sum(1),
    }
    for n, w in want.items():
        np.testing.assert_allclose(got[n], w, atol=1e-9, err_msg=n)


def test_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(metrics.cosine("a", "b")).collect()]
    assert got == [1.0, None, None, 1.0]
    assert [r[0] for r in df.select(metrics.hamming("a", "b")).collect()] == [1.0, None, None, 0.0]
    assert df.select(metrics.normalized("a")).first()[0] == [0.0, 0.0]
    with pytest.raises(ValueError):
        metrics.metric("nope")


def test_scalars(spark):
    df = spark.createDataFrame([("s3://b/c/x.y.parquet", 1572864, 7)], "p string, b bigint, n bigint")
    got = df.select(scalars.basename("p"), scalars.stem("p"), scalars.scheme("p"), scalars.size_mb("b"), scalars.epochs("n", 3)).first()
    assert tuple(got) == ("x.y.parquet", "x", "s3", "1.500 MB", 3)
    # 25,000 is between two multiples and goes to the even one
    one = df.select(scalars.rows_per_file(F.lit(1000), F.lit(1000), 25_000), scalars.rows_per_file(F.lit(0), F.lit(0), 5), scalars.rows_per_file(F.lit(1000), F.lit(1000), 35_000)).first()
    assert tuple(one) == (20_000, 10_000, 40_000)
    with pytest.raises(ValueError):
        scalars.epochs("n", 0)
