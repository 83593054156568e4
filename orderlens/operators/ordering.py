"""Positions, running totals, ranks and exact quantiles over a total order, without ever
putting the whole order into one task.

The rows are range-partitioned once and written with their partition number. Totals per
partition (a few numbers each) give every partition its offset; the rest is a window
inside one partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.columns import dbl
from orderlens.session import stage

COPIES_PER_CHUNK = 10_000
# Size of a KLL sketch, and a rank error (as a share of the rows) that it keeps with near certainty.
KLL_SIZE = 4096
KLL_ERROR = 0.002


def running_before(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], within: Sequence[str] = ()
) -> DataFrame:
    """Add, for each ``new: column`` of ``sums``, the sum of ``column`` over all earlier rows.

    ``order`` must be total (no ties) so that one value cannot fill a partition; with
    ``within`` the sums start again in each group.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc() for c in within], *order)
    rows = stage(ranged.withColumn("_part", F.spark_partition_id()))
    groups = ["_part", *within]
    totals = rows.groupBy(*groups).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    # One row per partition and group in it: partitions + groups rows at most.
    before = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    local = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = [
        (F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_off_{n}")).alias(n)
        for n, c in sums.items()
    ]
    return rows.join(F.broadcast(offsets), groups).select(*df.columns, *running)


# Up to so many rows a side that is looked up is sent to every task; it is counted first.
MOST_SENT = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows) written once and, if it is small by count, marked to be sent to the tasks."""
    rows = stage(df)
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def rank_desc(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """``rank() over (order by value desc)`` for any number of rows; ``key`` is unique."""
    order = [F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last()]
    placed = running_before(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_above": "_one"})
    first = placed.groupBy(F.col(value).alias("_value")).agg((F.min("_above") + 1).alias(name))
    return placed.join(first, F.col(value).eqNullSafe(F.col("_value"))).drop(
        "_value", "_one", "_above"
    )


def repeat_rows(df: DataFrame, copies: str, index: str) -> DataFrame:
    """Each row ``copies`` times with a running ``index``. Every row is first cut into chunks
    of at most ``COPIES_PER_CHUNK`` copies, which Spark spreads evenly by their size."""
    number, size = F.col(copies), F.lit(COPIES_PER_CHUNK).cast("bigint")
    zero = F.lit(0).cast("bigint")
    first = F.col("_chunk") * size
    return (
        df.filter(number > 0)
        .withColumn("_chunk", F.explode(F.sequence(zero, F.floor((number - 1) / size))))
        .hint("rebalance")
        .withColumn(index, F.explode(F.sequence(first, F.least(number, first + size) - 1)))
        .drop("_chunk")
    )


def sum_of_largest(df: DataFrame, value: str, n: int, most: int = 100_000) -> DataFrame:
    """One row (``total``): the sum of the ``n`` largest of a column without missing values.

    Rows are never brought into order. Each pass brackets the n-th largest by a sketch of the
    values still in question, adds up what lies above the bracket and keeps what lies inside;
    when at most ``most`` different values are left, their counts are ordered. Of tied values
    any will do, so the last one counts as often as there is room. ``df`` is read per pass.
    """
    inside, found = df.select(value), []
    rest = n
    while True:
        values = inside.groupBy(value).agg(F.count("*").alias("copies"))
        if values.limit(most + 1).count() <= most:
            break
        rows = inside.count()
        around = [min(max(1 - (rest + s * rows) / rows, 0.0), 1.0) for s in (KLL_ERROR, -KLL_ERROR)]
        sketch = inside.agg(F.kll_sketch_agg_double(dbl(value), F.lit(KLL_SIZE)).alias("kll"))
        low, high = sketch.select(F.kll_sketch_get_quantile_double("kll", F.array(*map(F.lit, around)))).first()[0]
        above = inside.filter(dbl(value) > high).agg(F.count("*").alias("n"), F.sum(value).alias("total")).first()
        below = inside.filter(dbl(value) < low).count()
        # A bracket that misses the n-th value, which the sketch's error bound excludes, is left unused.
        top = above.n < rest
        bottom = rows - below >= rest
        if not ((top and above.n) or (bottom and below)):
            break
        if top:
            found.append(above.total)
            rest -= above.n
            inside = inside.filter(dbl(value) <= high)
        if bottom:
            inside = inside.filter(dbl(value) >= low)
    before = W.orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    counts = values.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    used = F.greatest(F.least(F.col("copies"), F.lit(rest) - F.col("before")), F.lit(0))
    known = [F.lit(t) for t in found if t is not None]
    total = F.coalesce(F.sum(F.col(value) * used.cast("decimal(18,0)")), F.lit(0))
    return counts.agg(reduce(lambda a, b: a + b, known, total).alias("total"))


def quantile_sketch(columns: dict[str, Column]) -> list[Column]:
    """One mergeable sketch per column, for ``exact_quantiles``."""
    return [F.kll_sketch_agg_double(v, F.lit(KLL_SIZE)).alias(f"_kll_{c}") for c, v in columns.items()]


def exact_quantiles(df: DataFrame, probs: dict[str, float], sketch: DataFrame | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of each column of ``df`` (all double): one row
    per column with the names of ``probs``.

    ``sketch`` is the row of ``quantile_sketch``, for a caller that has it from another pass.
    Quantiles of the sketch a little before and behind each probability bracket the value. One
    pass counts the rows before, between and behind the brackets, another the values inside
    them; only these are brought into order. A quantile outside its bracket, which the sketch's
    error all but excludes, would widen the brackets.
    """
    slack = KLL_ERROR
    columns = {c: F.col(c) for c in df.columns}
    if sketch is None:
        sketch = df.agg(*quantile_sketch(columns))
    sketch = stage(sketch)
    while True:
        around = [min(max(p + s, 0.0), 1.0) for p in probs.values() for s in (-slack, slack)]
        near = [
            F.when(
                F.kll_sketch_get_n_double(f"_kll_{c}") > 0,
                F.kll_sketch_get_quantile_double(f"_kll_{c}", F.array(*map(F.lit, around))),
            ).alias(f"_near_{c}")
            for c in columns
        ]
        # A row per column, written so that the check and the caller read it.
        found = stage(_quantiles_near(df, probs, _spans(sketch.select(*near).first(), df.columns)))
        if found.filter("outside").isEmpty():
            return found.drop("outside")
        slack *= 16


def _spans(sketch, columns: list[str]) -> dict[str, list[tuple[float, float]]]:
    """Per column the brackets in order, overlapping ones merged: a handful of numbers."""
    spans: dict[str, list[tuple[float, float]]] = {}
    for column in columns:
        merged: list[tuple[float, float]] = []
        for low, high in sorted(batched(sketch[f"_near_{column}"] or [0.0, 0.0], 2)):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        spans[column] = merged
    return spans


def _quantiles_near(df: DataFrame, probs: dict[str, float], spans: dict[str, list[tuple[float, float]]]) -> DataFrame:
    numbers = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(k).alias("span"),
            F.count(column).alias("rows"),
            F.count_if(F.col(column) < low).alias("below"),
        )
        for column, merged in spans.items()
        for k, (low, _) in enumerate(merged)
    ]
    # One row per column and bracket.
    sizes = df.agg(F.array(*numbers).alias("numbers")).select(F.inline("numbers"))
    inside = [
        F.struct(
            F.lit(column).alias("column"),
            reduce(lambda e, k: e.when(F.col(column).between(*merged[k]), k), range(len(merged)), F.when(F.lit(False), 0)).alias("span"),
            F.col(column).alias("value"),
        )
        for column, merged in spans.items()
    ]
    # No filter on rows before this: it would be pushed below the columns' own expressions and
    # evaluate those once per bracket.
    counts = (
        df.select(F.inline(F.array(*inside)))
        .filter(F.col("span").isNotNull())
        .groupBy("column", "span", "value")
        .agg(F.count("*").alias("n"))
    )
    placed = running_before(counts, [F.col("value").asc()], {"start": "n"}, ["column", "span"])
    placed = sizes.join(placed, ["column", "span"], "left").withColumn("start", F.col("start") + F.col("below"))
    picked = []
    for name, p in probs.items():
        spot = (F.col("rows") - 1) * F.lit(p)
        for side, at in (("lower", F.floor(spot)), ("upper", F.ceil(spot))):
            here = (F.col("start") <= at) & (at < F.col("start") + F.col("n"))
            picked.append(F.max(F.when(here, F.col("value"))).alias(f"{side}_{name}"))
    found = placed.groupBy("column").agg(F.max("rows").alias("rows"), *picked)
    values, missed = [], []
    for name, p in probs.items():
        spot = (F.col("rows") - 1) * F.lit(p)
        low, high = F.col(f"lower_{name}"), F.col(f"upper_{name}")
        values.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
        missed += [low.isNull(), high.isNull()]
    outside = (F.col("rows") > 0) & reduce(lambda a, b: a | b, missed)
    return found.select("column", *values, outside.alias("outside"))
