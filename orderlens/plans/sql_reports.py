"""The fifteen SQL reports on the cleaned orders: rounded to two decimals, missing keys
kept as a group, rows (not ids) counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.columns import (
    band_by_case,
    mean2,
    percent2,
    year_month,
)
from orderlens.operators.measures import added
from orderlens.operators.ordering import rank_desc
from orderlens.plans.parts import (
    amount,
    by_customer_attribute,
    largest,
    overall,
    overdue,
    per_customer,
    per_product,
    totals,
)
from orderlens.warehouse import Sales

MONEY_SUMS = ("net_sales", "profit")
KPI_SUMS = ("quantity", "gross_sales", "discount_amount", "net_sales", "profit")


def kpi_columns() -> list:
    """Headline figures from summed measures."""
    return [
        F.col("orders").alias("total_orders"),
        F.col("quantity").alias("units_sold"),
        amount("gross_sales"),
        amount("discount_amount", "total_discount"),
        amount("net_sales"),
        amount("profit"),
        percent2("profit", "net_sales").alias("profit_margin_pct"),
        mean2("net_sales", "net_rows").alias("avg_order_value"),
    ]


def headline(sales: Sales) -> DataFrame:
    return sales.summed([], ("orders", "net_rows", *KPI_SUMS)).select(*kpi_columns())


def monthly_totals(sales: Sales) -> DataFrame:
    """Per calendar month: as many rows as there are months."""
    months = sales.summed(["month"], ("orders", *MONEY_SUMS))
    return months.withColumn("year_month", year_month(F.col("month")))


def monthly_trend(sales: Sales) -> DataFrame:
    """Growth is against the previous month present."""
    before = F.lag("net_sales").over(W.orderBy(F.col("year_month").asc_nulls_first()))
    return (
        monthly_totals(sales)
        .withColumn("before", before)
        .select(
            "year_month",
            "orders",
            amount("net_sales"),
            amount("profit"),
            percent2(F.col("net_sales") - F.col("before"), "before").alias("mom_growth_pct"),
        )
        .orderBy(F.col("year_month").asc_nulls_first())
    )


def quarterly(sales: Sales) -> DataFrame:
    """Quarters of all years together."""
    return (
        sales.summed(["quarter"], ("orders", *MONEY_SUMS))
        .select(
            F.concat(F.lit("Q"), "quarter").alias("quarter"),
            "orders",
            amount("net_sales"),
            amount("profit"),
            percent2("profit", "net_sales").alias("margin_pct"),
        )
        .orderBy(F.col("quarter").asc_nulls_first())
    )


def category_performance(sales: Sales) -> DataFrame:
    """The share is of all orders with a known product."""
    return (
        sales.summed(["category"], ("orders", "quantity", *MONEY_SUMS))
        .withColumn("all_sales", overall("net_sales"))
        .select(
            "category",
            "orders",
            F.col("quantity").alias("units"),
            amount("net_sales"),
            amount("profit"),
            percent2("profit", "net_sales").alias("margin_pct"),
            percent2("net_sales", "all_sales").alias("sales_share_pct"),
        )
        .orderBy(F.desc("net_sales"), "category")
    )


def top_products(sales: Sales, n: int = 5) -> DataFrame:
    best = largest(per_product(sales, ("quantity", *MONEY_SUMS)), "net_sales", n, "product_id")
    return best.select(
        "product_id",
        "product_name",
        "category",
        F.col("quantity").alias("units"),
        amount("net_sales"),
        amount("profit"),
    )


def bottom_margin_products(sales: Sales, n: int = 5) -> DataFrame:
    """Lowest rounded margins; a missing margin sorts first."""
    return (
        per_product(sales, MONEY_SUMS)
        .select(
            "product_id",
            "product_name",
            "category",
            amount("net_sales"),
            percent2("profit", "net_sales").alias("margin_pct"),
        )
        .orderBy(F.col("margin_pct").asc_nulls_first(), "product_id")
        .limit(n)
    )


def best_product_per_category(sales: Sales) -> DataFrame:
    """Rank 1 per category and product name, ties kept. Spark drops the others before the
    shuffle (window group limit), so a category with most products stays small."""
    named = per_product(sales, ("net_sales",)).groupBy("category", "product_name")
    place = F.rank().over(W.partitionBy("category").orderBy(F.col("net_sales").desc_nulls_last()))
    return (
        named.agg(F.sum("net_sales").alias("net_sales"))
        .withColumn("place", place)
        .filter(F.col("place") == 1)
        .select("category", "product_name", amount("net_sales"))
        .orderBy(F.desc("net_sales"), "category", "product_name")
    )


def city_sales(sales: Sales) -> DataFrame:
    return (
        by_customer_attribute(sales, "city", MONEY_SUMS)
        .select("city", "customers", "orders", amount("net_sales"), amount("profit"))
        .orderBy(F.desc("net_sales"), "city")
    )


def customer_type_sales(sales: Sales) -> DataFrame:
    return (
        by_customer_attribute(sales, "customer_type", MONEY_SUMS)
        .select(
            "customer_type",
            "customers",
            "orders",
            amount("net_sales"),
            mean2("net_sales", "net_rows").alias("avg_order_value"),
            percent2("profit", "net_sales").alias("margin_pct"),
        )
        .orderBy(F.desc("net_sales"), "customer_type")
    )


def top_customers(sales: Sales, n: int = 10) -> DataFrame:
    """Known customers only; their missing attributes stay missing."""
    master = sales.customers.select("customer_id", "customer_name", "city", "customer_type")
    known = totals(sales, "customer_id", MONEY_SUMS).join(master, "customer_id")
    best = largest(known, "net_sales", n, "customer_id")
    return best.select(
        "customer_id",
        "customer_name",
        "city",
        "customer_type",
        "orders",
        amount("net_sales"),
        amount("profit"),
    )


def salesperson_rank(sales: Sales) -> DataFrame:
    names = ("orders", *MONEY_SUMS, "discount", "discount_rows")
    people = added(
        sales.summed(["salesperson", "payment_status"], names),
        ["salesperson"],
        names,
        overdue("orders").alias("overdue_orders"),
    )
    return (
        rank_desc(people, "net_sales", "salesperson", "sales_rank")
        .select(
            "salesperson",
            "orders",
            amount("net_sales"),
            amount("profit"),
            percent2("profit", "net_sales").alias("margin_pct"),
            mean2("discount", "discount_rows").alias("avg_discount_pct"),
            "overdue_orders",
            "sales_rank",
        )
        .orderBy("sales_rank", "salesperson")
    )


def payment_status_summary(sales: Sales) -> DataFrame:
    return (
        sales.summed(["payment_status"], ("orders", "net_sales"))
        .withColumn("all_sales", overall("net_sales"))
        .select(
            "payment_status",
            "orders",
            amount("net_sales"),
            percent2("net_sales", "all_sales").alias("share_pct"),
        )
        .orderBy(F.col("net_sales").desc_nulls_last(), "payment_status")
    )


def top_overdue_customers(sales: Sales, n: int = 10) -> DataFrame:
    people = per_customer(sales, ("net_sales",), status="Overdue")
    return largest(people, "net_sales", n, "customer_id").select(
        "customer_id",
        "customer_name",
        "city",
        F.col("orders").alias("overdue_orders"),
        amount("net_sales", "overdue_amount"),
    )


def discount_band_margin(sales: Sales) -> DataFrame:
    names = ("orders", *MONEY_SUMS, "rounded_losses")
    values = sales.summed(["discount_pct"], names)
    return (
        added(values.withColumn("discount_band", band_by_case(F.col("discount_pct"))), ["discount_band"], names)
        .select(
            "discount_band",
            "orders",
            amount("net_sales"),
            percent2("profit", "net_sales").alias("margin_pct"),
            F.col("rounded_losses").alias("loss_orders"),
        )
        .orderBy("discount_band")
    )


def loss_orders(sales: Sales) -> DataFrame:
    """Loss here means rounded profit below zero. The join drops the lines of unknown products, so
    the lines meet the products once."""
    columns = ("order_id", "order_date", "product_id", "salesperson", "discount_pct", *MONEY_SUMS)
    losses = sales.lines(*columns).filter(F.col("profit") < 0)
    return (
        losses.join(sales.products.select("product_id", "product_name", "category"), "product_id")
        .select(
            "order_id",
            "order_date",
            "product_name",
            "category",
            "salesperson",
            amount("discount_pct"),
            amount("net_sales"),
            amount("profit"),
        )
        .orderBy("profit", "order_id")
    )
