"""Building splits: dense ids, shuffles, slices, batches and disjoint train and test sets.

Dense numbers come from counts by partition and a range partitioning, not from a window over one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.sources.shared import cut


def dense_ids(df: DataFrame, order: list[str | Column], *, name: str = "id", start: int = 0) -> DataFrame:
    """df with a column that counts from start on, in the given order, which must tell any two rows apart.

    Rows are sorted over ranges; within a range a window counts, and the sizes of the ranges before (one row each) are added.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    part, own, n, before = free_names(df, "part", "own", "n", "before")
    ranged = cut(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))  # ranges are drawn anew each time that a plan runs
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sizes = sizes.withColumn(before, F.coalesce(F.sum(n).over(upto), F.lit(0))).select(part, before)
    counted = ranged.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    return counted.join(F.broadcast(sizes), part).select(*(F.col(f"`{c}`") for c in df.columns), (F.col(own) + F.col(before) - 1 + start).cast("bigint").alias(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def shuffled(df: DataFrame, pk: str, seed: int = 0) -> DataFrame:
    """df in an order that only the keys and the seed decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), pk), pk)


def sample(df: DataFrame, pk: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, or all if there are fewer, in the order of shuffled()."""
    return _between(df, [F.xxhash64(F.lit(seed), pk), F.col(pk)], 0, n)


def slice_rows(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1 in the given order, counted from 0. They are never gathered in one place."""
    if not 0 <= start <= stop:
        raise ValueError("0 <= start <= stop")
    return _between(df, order, start, stop)


def _between(df: DataFrame, order: list[str | Column], start: int, stop: int) -> DataFrame:
    (at,) = free_names(df, "at")
    return dense_ids(df, order, name=at).where((F.col(at) >= start) & (F.col(at) < stop)).orderBy(at).drop(at)


def batch_numbers(df: DataFrame, order: list[str], batch_size: int, name: str = "batch") -> DataFrame:
    """df with the number of each row's batch: batches of exactly batch_size rows, the last may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    (at,) = free_names(df, "at")
    return dense_ids(df, order, name=at).withColumn(name, F.expr(f"`{at}` div {batch_size}")).drop(at)


def train_test(df: DataFrame, order: list[str | Column], *, train: int, test: int, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `train` rows in the given order, and the next `test` ones; for each value of `by` if given."""
    (at,) = free_names(df, "at")
    if by:
        ranked = df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col(at) < train + test)
    else:
        ranked = cut(dense_ids(df, order, name=at).where(F.col(at) < train + test))
    return ranked.where(F.col(at) < train).drop(at), ranked.where(F.col(at) >= train).drop(at)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns by name; a part's missing columns are null."""
    if not parts:
        raise ValueError("nothing to unite")
    out = parts[0].select("*")  # of rows, where it was a range
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
