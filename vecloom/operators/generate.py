"""Synthetic vectors, standardisation, principal components and Gaussian mixtures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _drawn(ids: DataFrame, draw, seed: int) -> DataFrame:
    """(id, embedding) of ids (id, ...), drawn block by block: a block's generator depends on the seed and its number only."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                first, n = r["block"] * _ROWS, r["n"]
                x = draw(np.random.default_rng([seed, r["block"]]), np.arange(first, first + n)).astype(np.float32)
                for at in range(0, n, 1024):
                    part = x[at : at + 1024]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part))), lists], names=["id", "embedding"])

    return ids.mapInArrow(run, "id bigint, embedding array<float>")


_ROWS = 4096


def _blocks(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(-(-rows // _ROWS)).select(F.col("id").alias("block"), F.least(F.lit(_ROWS), F.lit(rows) - F.col("id") * _ROWS).cast("int").alias("n"))


def random_vectors(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """(id, embedding): values uniform in [0, 1). The same for any number of partitions."""
    return _drawn(_blocks(spark, rows), lambda rng, ids: rng.random((len(ids), dim)), seed)


def cluster_vectors(spark: SparkSession, rows: int, dim: int, clusters: int, seed: int = 42) -> DataFrame:
    """(id, embedding): points around centres, id k in cluster k mod clusters, so that sizes differ by one at most."""
    if clusters < 1:
        raise ValueError("clusters must be positive")

    def draw(rng, ids):
        centres = np.random.default_rng(seed).standard_normal((clusters, dim)) * 10
        return centres[ids % clusters] + rng.standard_normal((len(ids), dim)) * 2

    return _drawn(_blocks(spark, rows), draw, seed)


def moments(df: DataFrame, vector: str) -> DataFrame:
    """(at, mean, deviation) of each place of the vectors; the deviation is that of the population.

    Vectors are added up as a whole, in each task and then over tasks. Null vectors don't count.
    """
    found = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    one = found.groupBy(F.lit(1)).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    share = F.when(F.col("s.count") > 1, (F.col("s.count") - 1) / F.col("s.count")).otherwise(F.lit(0.0))
    each = one.select(F.posexplode(F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))).alias("at", "x"), share.alias("share"))
    return each.select("at", F.col("x.mean").alias("mean"), F.sqrt(F.col("x.variance") * F.col("share")).alias("deviation"))


def standardize(df: DataFrame, vector: str, out: str = "standardized") -> tuple[DataFrame, list[float], list[float]]:
    """df with vectors of mean 0 and deviation 1, and the means and deviations; places without deviation only lose their mean."""
    rows = sorted(moments(df, vector).collect())  # one row a place
    mean, deviation = [r[1] for r in rows], [r[2] or 1.0 for r in rows]
    ab = F.arrays_zip(F.col(vector).cast("array<double>").alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, deviation)).alias("s"))
    return df.withColumn(out, F.transform(ab, lambda t: (t["x"] - t["m"]) / t["s"])), mean, deviation


def restore(df: DataFrame, vector: str, mean: list[float], deviation: list[float], out: str = "restored") -> DataFrame:
    """Undoes standardize()."""
    ab = F.arrays_zip(F.col(vector).alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, deviation)).alias("s"))
    return df.withColumn(out, F.transform(ab, lambda t: t["x"] * t["s"] + t["m"]))


def pca(df: DataFrame, vector: str, k: int, out: str = "projected") -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """df with the projections of the centred vectors, the components (dim x k), the mean and the explained shares."""
    rows = sorted(moments(df, vector).collect())
    mean = np.array([r[1] for r in rows])
    ab = F.arrays_zip(F.col(vector).cast("array<double>").alias("x"), F.array(*(F.lit(float(m)) for m in mean)).alias("m"))
    centred = df.withColumn("_centred", array_to_vector(F.transform(ab, lambda t: t["x"] - t["m"])))
    model = PCA(k=k, inputCol="_centred", outputCol="_projected").fit(centred)
    projected = model.transform(centred).withColumn(out, vector_to_array("_projected")).drop("_centred", "_projected")
    return projected, model.pc.toArray(), mean, model.explainedVariance.toArray()


def unproject(df: DataFrame, vector: str, components: np.ndarray, mean: np.ndarray, out: str = "restored") -> DataFrame:
    """The vectors of the full space that projections stand for."""
    c, m = components.copy(), mean.copy()

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            x = np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) @ c.T + m
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def mixture(df: DataFrame, vector: str, components: int, seed: int = 42):
    """A Gaussian mixture fitted to the vectors: (weights, means, covariances)."""
    model = GaussianMixture(k=components, seed=seed, featuresCol="_v").fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))
    gaussians = model.gaussiansDF.collect()  # one row a component
    return np.array(model.weights), np.stack([g["mean"].toArray() for g in gaussians]), np.stack([g["cov"].toArray() for g in gaussians])


def mixture_sample(spark: SparkSession, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, rows: int, seed: int = 42) -> DataFrame:
    """(id, embedding) drawn from a mixture: a component by its weight, then its normal distribution."""
    roots = np.stack([np.linalg.cholesky(c + 1e-9 * np.trace(c) * np.eye(len(c))) for c in covariances])
    share = weights / weights.sum()

    def draw(rng, ids):
        of = rng.choice(len(share), len(ids), p=share)
        z = rng.standard_normal((len(ids), means.shape[1]))
        return means[of] + np.einsum("nij,nj->ni", roots[of], z)

    return _drawn(_blocks(spark, rows), draw, seed)
