"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_mb(size: Column | str) -> Column:
    """Bytes as text, like "1.500 MB"."""
    return F.format_string("%.3f MB", F.col(size).cast("double") / 1048576 if isinstance(size, str) else size.cast("double") / 1048576)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scheme(url: Column | str) -> Column:
    """What comes before ://, empty if there is none."""
    return F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def stem(path: Column | str) -> Column:
    """The base name up to its first dot."""
    return F.element_at(F.split(basename(path), r"\."), 1)


def epochs(rows: Column | str, most: int) -> Column:
    """The number of blocks of at most `most` rows, 1 at least."""
    if most < 1:
        raise ValueError("most must be positive")
    return F.greatest(F.lit(1), F.ceil((F.col(rows) if isinstance(rows, str) else rows) / F.lit(most))).cast("bigint")


def rows_per_file(bytes_: Column, rows: Column, target_bytes: int, step: int = 10_000) -> Column:
    """Rows of a file of about target_bytes: the nearest multiple of step (half to even), step at least.

    No rows, or rows of no bytes, give step.
    """
    return F.greatest(F.lit(step), F.coalesce(F.bround(F.try_divide(F.lit(float(target_bytes)), F.try_divide(bytes_.cast("double"), rows.cast("double"))) / F.lit(float(step))) * step, F.lit(step))).cast("bigint")
