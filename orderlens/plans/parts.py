"""Aggregation steps the reports share.

Every report that needs a master attribute first sums the lines per customer or product
id and joins the master to that: the join meets each id once, a hot id is one row per
task, and a distinct count of ids becomes a plain count. Sums are decimals, so summing
in two steps gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.columns import dbl
from orderlens.operators.cleaning import add_customer
from orderlens.operators.measures import AMOUNTS, Where
from orderlens.warehouse import Sales


def again(df: DataFrame, keys: list[Column | str], *extra: Column) -> DataFrame:
    """Sum the result of ``totals`` over coarser keys."""
    names = [c for c in ("orders", "net_rows", *AMOUNTS) if c in df.columns]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], *extra)


def totals(
    sales: Sales, key: str, amounts: tuple[str, ...], frame: bool = False, where: Where | None = None
) -> DataFrame:
    """``orders``, summed amounts and (if net sales are summed) their number, per id.

    ``frame`` selects the conventions of the frame reports: present order ids are counted
    instead of rows, and the sum of only missing values is 0.
    """
    orders = "ids" if frame else "orders"
    names = (orders, *(["net_rows"] if "net_sales" in amounts else []), *amounts)
    summed = sales.summed([key], names, where).withColumnRenamed(orders, "orders")
    return summed.fillna(0, list(amounts)) if frame else summed


def per_product(sales: Sales, amounts: tuple[str, ...], frame: bool = False) -> DataFrame:
    master = sales.products.select("product_id", "product_name", "category")
    return totals(sales, "product_id", amounts, frame).join(master, "product_id", "inner")


def per_customer(
    sales: Sales, amounts: tuple[str, ...], frame: bool = False, status: str | None = None
) -> DataFrame:
    where = {"payment_status": status} if status else None
    return add_customer(totals(sales, "customer_id", amounts, frame, where), sales.customers)


def by_customer_attribute(
    sales: Sales, attribute: str, amounts: tuple[str, ...], frame: bool = False
) -> DataFrame:
    customers = F.count("customer_id").alias("customers")
    return again(per_customer(sales, amounts, frame), [attribute], customers)


def overall(column: str) -> Column:
    """Total over the groups of an attribute with few values; use after aggregation only."""
    return F.sum(column).over(W.partitionBy())


def overdue(count: str) -> Column:
    """The part of a count that is of overdue orders; the status is a key of the sums."""
    return F.coalesce(F.sum(F.when(F.col("payment_status") == "Overdue", F.col(count))), F.lit(0))


def amount(column: str, name: str | None = None) -> Column:
    return dbl(column).alias(name or column)


def largest(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(n)
