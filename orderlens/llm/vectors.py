"""Embedding columns as whole-number matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A column whose lists all have ``width`` entries, as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def complete(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``width`` finite entries, and those vectors."""
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    at = np.flatnonzero(lengths == width)
    values = matrix(lists.take(pa.array(at)), width).astype(float)
    whole = np.isfinite(values).all(axis=1)
    return at[whole], values[whole]


def lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(rows.ravel()))


def no_null(values: Column, test) -> Column:
    """True if no entry is null and all pass."""
    return F.coalesce(F.forall(values, lambda c: F.coalesce(test(c), F.lit(False))), F.lit(False))
