"""Statistics of splits and of measured values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_summary(splits: dict[str, DataFrame]) -> DataFrame:
    """(split, num_rows, num_columns) for each split; the counts are one job."""
    out = None
    for name, df in splits.items():
        one = df.agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(name).alias("split"), "num_rows", F.lit(len(df.columns)).cast("bigint").alias("num_columns"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no split")
    return out


def value_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least, largest and sample deviation (0 for one value) of each group, and its count."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("deviation")
    )
