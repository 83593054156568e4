"""Additive measures of the cleaned order lines, and exact customer counts that add up too.

A report names the keys and measures it needs; whoever holds the sales answers from the lines
or from sums made before. Money is decimal and counts are whole, so sums of sums equal the sums
of the lines. A distinct count of customers does not add up; two things do. A bitmap of them:
customers are numbered without gaps, and each block of 32,768 numbers is one bitmap of 4 kB per
group. And marks: of the lines of a customer that share some of the keys, one is marked as first.
Bitmaps serve few groups; where groups have few customers each, they would be mostly zeros, and
marks take one number per group instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.operators.ordering import running_before, small_side
from orderlens.session import stage

AMOUNTS = ("quantity", "gross_sales", "discount_amount", "net_sales", "cost", "profit")

# Key -> (line columns it needs, expression); other keys are columns.
KEYS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "month": (("order_date",), lambda: F.trunc("order_date", "month")),
    "quarter": (("order_date",), lambda: F.quarter("order_date")),
    "order_month_num": (("order_date",), lambda: F.month("order_date")),
}

# Measure -> (line columns it needs, aggregate).
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "orders": ((), lambda: F.count("*")),
    "ids": (("order_id",), lambda: F.count("order_id")),
    "net_rows": (("net_sales",), lambda: F.count("net_sales")),
    "discount": (("discount_pct",), lambda: F.sum("discount_pct")),
    "discount_rows": (("discount_pct",), lambda: F.count("discount_pct")),
    "losses": (("is_loss",), lambda: F.count_if("is_loss")),
    "rounded_losses": (("profit",), lambda: F.count_if(F.col("profit") < 0)),
    **{a: ((a,), lambda a=a: F.sum(a)) for a in AMOUNTS},
}
COUNTS = ("orders", "ids", "net_rows", "discount_rows", "losses", "rounded_losses")
# Keys with so few values that lines are best summed per product before the product is looked up.
FEW = {"payment_status", "quarter"}

Where = Mapping[str, object]


def columns_of(keys: Iterable[str], measures: Iterable[str]) -> list[str]:
    """The line columns that keys and measures need."""
    needed = [c for k in keys for c in (KEYS[k][0] if k in KEYS else (k,))]
    needed += [c for m in measures for c in MEASURES[m][0]]
    return list(dict.fromkeys(needed))


def picked(df: DataFrame, where: Where) -> DataFrame:
    for name, value in where.items():
        df = df.filter(F.col(name) == value)
    return df


def with_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.withColumns({k: KEYS[k][1]() for k in keys if k in KEYS})


def summed(lines: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return with_keys(lines, keys).groupBy(*keys).agg(*[MEASURES[m][1]().alias(m) for m in measures])


def added(sums: DataFrame, keys: Sequence[str], measures: Sequence[str], *extra: Column) -> DataFrame:
    """Sums over coarser keys; without keys and rows the counts are 0."""
    total = sums.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures], *extra)
    return total.fillna(0, [m for m in measures if m in COUNTS])


def sum_lines(sales, keys: Sequence[str], measures: Sequence[str], where: Where) -> DataFrame:
    """From the lines of ``sales`` (with ``lines``, ``facts`` and ``products``). The product
    master is met once: for its category, or to drop the lines of unknown products. Sums per
    product id alone still hold unknown ones; whoever looks the products up drops them there."""
    names = {*keys, *where}
    needed = columns_of((n for n in names if n != "category"), measures)
    of_lines = {k: v for k, v in where.items() if k != "category"}
    if "category" in names:
        lines = picked(sales.lines("product_id", *needed), of_lines)
        master = sales.products.select("product_id", "category")
        master = picked(master, {k: v for k, v in where.items() if k == "category"})
        if set(keys) == {"category"}:
            per_product = summed(lines, ["product_id"], measures)
            return added(per_product.join(master, "product_id"), keys, measures)
        return summed(lines.join(master, "product_id"), keys, measures)
    if names == {"product_id"}:
        return summed(sales.lines("product_id", *needed), keys, measures)
    if names <= FEW:
        lines = picked(sales.lines("product_id", *needed), of_lines)
        per_product = summed(lines, [*keys, "product_id"], measures)
        # As a semi join it would be pushed below the sum, and every line would be looked up.
        known = per_product.join(sales.products.select("product_id").distinct(), "product_id")
        return added(known, keys, measures)
    return summed(picked(sales.facts(*needed), of_lines), keys, measures)


def with_customers(per_customer: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row from the sums per customer: the measures and the number of present ids."""
    return added(per_customer, [], measures, F.count("customer_id").alias("customers"))


# Block of the rows that hold the measures of a group, and of those that hold its marks.
SUMS, MARKS = -1, -2
# Bitmaps are 4 kB each; with more of them than this, customers are marked instead.
MOST_BITMAPS = 4096
BLOCK_SIZE = 32_768


def mark(keys: Iterable[str]) -> str:
    """Column that counts first lines among those with the same customer and these keys."""
    return "_".join(["new", *sorted(keys)])


def has_marks(slices: DataFrame) -> bool:
    return mark(()) in slices.columns


def customer_slices(sums: DataFrame, pairs: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per group of ``keys``: a row with its ``measures`` (block -1), and per block of customers a
    row with them as a bitmap (``customers``) or, where these would be many, one row of marks.

    ``sums`` has the measures per group, ``pairs`` the group and customer of each line. Distinct
    pairs are narrow and written once, as several steps read them.
    """
    distinct = stage(pairs.distinct())
    known = distinct.filter(F.col("customer_id").isNotNull())
    ids = known.select("customer_id").distinct()
    groups = distinct.select(*keys).distinct().limit(MOST_BITMAPS + 1).count()
    few = groups <= MOST_BITMAPS and groups * (ids.count() // BLOCK_SIZE + 1) <= MOST_BITMAPS
    rows = customer_bitmaps(known, ids, keys) if few else customer_marks(known, keys)
    return sums.withColumn("block", F.lit(SUMS).cast("bigint")).unionByName(rows, allowMissingColumns=True)


def customer_bitmaps(distinct: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps are built after the shuffle: before it, a group with one customer would move 4 kB."""
    one = ids.withColumn("_one", F.lit(1).cast("bigint"))
    numbers = running_before(one, [F.col("customer_id").asc()], {"_number": "_one"}).drop("_one")
    place = F.col("_number") + 1
    return (
        distinct.join(small_side(numbers), "customer_id")
        .select(*keys, F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("_bit"))
        .repartition(*keys, "block")
        .groupBy(*keys, "block")
        .agg(F.bitmap_construct_agg("_bit").alias("customers"))
    )


def customer_marks(distinct: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and choice of its keys: how many customers it holds that no group before it with the
    same values of the chosen keys does. Summed over these groups, each customer counts once.

    All windows lie inside one customer, so the pairs are shuffled once.
    """
    rows, names = distinct.repartition("customer_id"), sorted(keys)
    for size in range(len(names)):
        for chosen in combinations(names, size):
            order = [F.col(k) for k in names if k not in chosen]
            first = F.row_number().over(W.partitionBy("customer_id", *chosen).orderBy(*order)) == 1
            rows = rows.withColumn(mark(chosen), first.cast("bigint"))
    rows = rows.withColumn(mark(names), F.lit(1).cast("bigint"))
    marks = [c for c in rows.columns if c not in (*keys, "customer_id")]
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in marks]).withColumn("block", F.lit(MARKS).cast("bigint"))


def counted(slices: DataFrame, keys: Sequence[str], measures: Sequence[str], picked: Iterable[str] = ()) -> DataFrame:
    """Slices to one row per group: blocks are disjoint, so their bits add up. Of ``picked`` keys
    the slices hold one value only."""
    if has_marks(slices):
        customers = F.coalesce(F.sum(mark({*keys, *picked})), F.lit(0)).alias("customers")
        return added(slices, keys, measures, customers)
    blocks = slices.groupBy(*keys, "block").agg(
        *[F.sum(m).alias(m) for m in measures], F.bitmap_or_agg("customers").alias("bits")
    )
    customers = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("customers")
    return added(blocks, keys, measures, customers)
