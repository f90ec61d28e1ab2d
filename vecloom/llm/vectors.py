"""Vectors of a table: which can be compared, folding of equal ones, and a small form that travels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, k0, k1, v) of each row: two hashes of the vector, null with v where it can't be compared.

    That is a null id, and a null, empty or all-zero vector, or one with nulls, NaN or infinity.
    """
    v = F.col(vector_col).cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    key = F.col(id_col).cast("bigint")
    own = vectors.select(key.alias("id"), F.when(fine & key.isNotNull(), F.transform(v, lambda x: x + F.lit(0.0).cast("float"))).alias("v"))  # -0 is 0
    hashed = lambda seed: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v"))
    return own.select("id", hashed(1).alias("k0"), hashed(2).alias("k1"), "v")


def matrix(column: pa.Array) -> np.ndarray:
    """Of a list column without nulls whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def small(u: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Rows of u as a byte a number, with each row's scale and the length of what rounding takes from it."""
    scale = (np.abs(u).max(1) / 127).astype(np.float32)
    q = np.round(u / scale[:, None].astype(np.float64)).astype(np.int8)
    lost = np.linalg.norm(u - q * scale[:, None].astype(np.float64), axis=1).astype(np.float32) + np.float32(1e-6)
    offsets = np.arange(0, q.size + 1, q.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(q))]), scale, lost


def restored(column: pa.Array, scale: np.ndarray) -> np.ndarray:
    """The rows that small() gives, about, as float32."""
    n = len(column)
    if not n:
        return np.zeros((0, 1), np.float32)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int8)
    return flat.reshape(n, -1).astype(np.float32) * scale[:, None]


def unsure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much at most a product of restored rows that lost a and b differs from the true one."""
    return a + b + 3 * a * b + 1e-6


def similarities(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with their cosine, in double precision; rows are (id, v)."""
    left = rows.select(F.col("id").alias("a"), F.col("v").alias("va"))
    right = rows.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(left, "a").join(right, "b")
    names = [*pairs.columns]

    def run(batches):
        for batch in batches:
            va, vb = batch.column(len(names)), batch.column(len(names) + 1)
            out = np.zeros(batch.num_rows)
            size = va.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for lo in range(0, len(at), 4096):
                    take = pa.array(at[lo : lo + 4096])
                    out[at[lo : lo + 4096]] = np.einsum("ij,ij->i", unit(matrix(va.take(take))), unit(matrix(vb.take(take))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out)], names=[*names, "similarity"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", similarity double"
    return both.select(*names, "va", "vb").mapInArrow(run, schema)
