"""First looks at a table: shape, missing values, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.columns import dbl
from orderlens.operators.ordering import exact_quantiles, quantile_sketch
from orderlens.schema import RAW_MONEY
from orderlens.session import stage


def shape_report(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows and columns per table, from (any columns of the table, its number of columns)."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(width).alias("cols")
        )
        for name, (df, width) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def preview(df: DataFrame, keys: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first rows by ``key``. ``keys`` holds the key alone: the n-th smallest comes from it,
    and only rows up to there are joined and ordered."""
    head = keys.filter(F.col(key).isNotNull()).select(key).orderBy(key).limit(n)
    bound = head.agg(F.max(key).alias("last"), F.count("*").alias("found"))
    near = (F.col(key) <= bound.select("last").scalar()) | (bound.select("found").scalar() < n)
    return df.filter(near).orderBy(F.col(key).asc_nulls_last()).limit(n)


def profile_nulls(df: DataFrame) -> DataFrame:
    """Non-null count and type per column, in one aggregation."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col(f.name).alias("non_null"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
        )
        for f in df.schema
    ]
    return counts.select(F.inline(F.array(*rows)))


def describe_numeric(df: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric and date column.

    Dates count as days since 1970-01-01 and have no std. The quartiles are exact.
    """
    dates = {f.name for f in df.schema if isinstance(f.dataType, T.DateType)}
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) or f.name in dates]
    values = {c: (F.unix_date(c) if c in dates else F.col(c)).cast(RAW_MONEY) for c in names}
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(v).alias("count"),
            F.try_divide(dbl(F.sum(v)), dbl(F.count(v))).alias("mean"),
            (F.lit(None) if c in dates else F.round(F.stddev_samp(dbl(v)), 4))
            .cast("double")
            .alias("std"),
            dbl(F.min(v)).alias("min"),
            dbl(F.max(v)).alias("max"),
        )
        for c, v in values.items()
    ]
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    doubles = {c: dbl(v) for c, v in values.items()}
    # One row, from one pass: the statistics and where the quartiles lie.
    first = stage(df.agg(F.array(*stats).alias("stats"), *quantile_sketch(doubles)))
    quartiles = exact_quantiles(df.select(*[v.alias(c) for c, v in doubles.items()]), probs, first)
    return (
        first.select(F.inline("stats"))
        .join(F.broadcast(quartiles), "column", "left")  # one row per column
        .select("column", "count", "mean", "std", "min", "q1", "median", "q3", "max")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each present value, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def date_range(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date")
    )
