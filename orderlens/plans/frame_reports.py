"""The eleven frame reports: unrounded, missing keys left out, present order ids counted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.columns import band_by_bins, dbl, month_name, percent
from orderlens.operators.measures import AMOUNTS, added, summed
from orderlens.operators.ordering import running_before, sum_of_largest
from orderlens.plans.parts import (
    again,
    amount,
    by_customer_attribute,
    largest,
    overall,
    overdue,
    per_customer,
    per_product,
)
from orderlens.schema import BANDS, STATUSES, literal_rows
from orderlens.session import stage
from orderlens.warehouse import Sales

MONEY_SUMS = ("net_sales", "profit")

# Fixed names of the headline figures.
KPI_NAMES = (
    "Total orders",
    "Units sold",
    "Gross sales (₹)",
    "Discount given (₹)",
    "Net sales (₹)",
    "Total cost (₹)",
    "Profit (₹)",
    "Profit margin (%)",
    "Avg order value (₹)",
    "Active customers",
    "Loss-making orders",
)


def margin() -> Column:
    return percent("profit", "net_sales").alias("margin_pct")


def mean(total: str, count: str) -> Column:
    return F.try_divide(dbl(total), dbl(count))


def kpi_full(sales: Sales) -> DataFrame:
    """Eleven figures as (metric, value). Unknown customer ids count as customers."""
    one = sales.with_customers(("orders", "net_rows", "losses", *AMOUNTS)).fillna(0)
    values = (
        dbl("orders"),
        dbl("quantity"),
        dbl("gross_sales"),
        dbl("discount_amount"),
        dbl("net_sales"),
        dbl("cost"),
        dbl("profit"),
        percent("profit", "net_sales"),
        mean("net_sales", "net_rows"),
        dbl("customers"),
        dbl("losses"),
    )
    rows = [
        F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in zip(KPI_NAMES, values)
    ]
    return one.select(F.inline(F.array(*rows)))


def monthly(sales: Sales) -> DataFrame:
    """By month of the year; the years fall together. Twelve rows at most."""
    months = sales.summed(["order_month_num"], ("ids", *MONEY_SUMS))
    before = F.lag(dbl("net_sales")).over(W.orderBy("order_month_num"))
    growth = (F.try_divide(dbl("net_sales"), before) - 1) * 100
    return (
        months.filter(F.col("order_month_num").isNotNull())
        .fillna(0, list(MONEY_SUMS))
        .select(
            "order_month_num",
            month_name(F.make_date(F.lit(2000), "order_month_num", F.lit(1))).alias("order_month"),
            F.col("ids").alias("orders"),
            amount("net_sales"),
            amount("profit"),
            margin(),
            growth.alias("mom_growth_pct"),
        )
        .orderBy("order_month_num")
    )


def category(sales: Sales) -> DataFrame:
    """The share is of the sales of all categories."""
    return (
        sales.summed(["category"], ("ids", "quantity", *MONEY_SUMS))
        .filter(F.col("category").isNotNull())
        .fillna(0, ["quantity", *MONEY_SUMS])
        .select(
            "category",
            F.col("ids").alias("orders"),
            F.col("quantity").alias("units"),
            amount("net_sales"),
            amount("profit"),
            margin(),
            percent("net_sales", overall("net_sales")).alias("sales_share_pct"),
        )
        .orderBy(F.desc("net_sales"), "category")
    )


def _products(sales: Sales) -> DataFrame:
    named = F.col("product_name").isNotNull() & F.col("category").isNotNull()
    return (
        per_product(sales, ("quantity", *MONEY_SUMS), frame=True)
        .filter(named)
        .select(
            "product_id",
            "product_name",
            "category",
            F.col("quantity").alias("units"),
            amount("net_sales"),
            amount("profit"),
            margin(),
        )
    )


def top_products(sales: Sales, n: int = 10) -> DataFrame:
    return largest(_products(sales), "net_sales", n, "product_id")


def bottom_margin_products(sales: Sales, n: int = 5) -> DataFrame:
    """Lowest unrounded margins; a missing margin comes last."""
    return (
        _products(sales).orderBy(F.col("margin_pct").asc_nulls_last(), "product_id").limit(n)
    )


def city(sales: Sales) -> DataFrame:
    return (
        by_customer_attribute(sales, "city", MONEY_SUMS, frame=True)
        .select("city", "customers", "orders", amount("net_sales"), amount("profit"), margin())
        .orderBy(F.desc("net_sales"), "city")
    )


def customer_type(sales: Sales) -> DataFrame:
    return (
        by_customer_attribute(sales, "customer_type", MONEY_SUMS, frame=True)
        .select(
            "customer_type",
            "customers",
            "orders",
            amount("net_sales"),
            amount("profit"),
            mean("net_sales", "net_rows").alias("avg_order_value"),
            margin(),
        )
        .orderBy(F.desc("net_sales"), "customer_type")
    )


CUSTOMER_KEYS = ("customer_id", "customer_name", "city", "customer_type")


def _ranked_customers(sales: Sales) -> DataFrame:
    """Customers by falling sales with the number and sales of those before them."""
    people = per_customer(sales, MONEY_SUMS, frame=True).filter(F.col("customer_id").isNotNull())
    people = people.select(*CUSTOMER_KEYS, "orders", *MONEY_SUMS, F.lit(1).alias("one"))
    order = [F.desc("net_sales"), F.asc("customer_id")]
    ranked = running_before(people, order, {"place": "one", "sales_before": "net_sales"})
    return ranked.drop("one")


def customers(sales: Sales) -> DataFrame:
    """All customers by sales with the running share of the total."""
    ranked = _ranked_customers(sales)
    everything = ranked.agg(F.sum("net_sales")).scalar()
    running = F.col("sales_before") + F.col("net_sales")
    return ranked.select(
        *CUSTOMER_KEYS,
        "orders",
        amount("net_sales"),
        amount("profit"),
        percent(running, everything).alias("cum_share_pct"),
    ).orderBy(F.desc("net_sales"), "customer_id")


def first_customers(sales: Sales, n: int = 10) -> DataFrame:
    """The head of ``customers`` without ranking them all: the running sum is over the top
    rows only, and both sums stand on the same totals per customer, which are made once."""
    people = stage(per_customer(sales, MONEY_SUMS, frame=True).filter(F.col("customer_id").isNotNull()))
    everything = people.agg(F.sum("net_sales")).scalar()
    running = F.sum("net_sales").over(
        W.orderBy(F.desc("net_sales"), "customer_id").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        largest(people, "net_sales", n, "customer_id")
        .withColumn("cum_share_pct", percent(running, everything))
        .select(*CUSTOMER_KEYS, "orders", amount("net_sales"), amount("profit"), "cum_share_pct")
        .orderBy(F.desc("net_sales"), "customer_id")
    )


def pareto(sales: Sales, share: float = 0.2) -> DataFrame:
    """Share of sales that the top fifth of the customers (rounded up) brings. Customers are
    selected by the value of the last of them, not brought into order."""
    people = per_customer_sales(sales)
    size = people.agg(F.count("*").alias("n"), F.sum("net_sales").alias("everything")).first()
    if not size.n:
        return people.select(F.lit(None).cast("bigint").alias("top_customers"), dbl("net_sales").alias("cum_share_pct")).limit(0)
    top = math.ceil(size.n * share)
    best = sum_of_largest(people, "net_sales", top)
    return best.select(
        F.lit(top).cast("bigint").alias("top_customers"),
        percent("total", F.lit(size.everything)).alias("cum_share_pct"),
    )


def per_customer_sales(sales: Sales) -> DataFrame:
    """customer_id and net_sales of each present id, made once."""
    people = sales.summed(["customer_id"], ("net_sales",)).fillna(0, ["net_sales"])
    return stage(people.filter(F.col("customer_id").isNotNull()).select("customer_id", "net_sales"))


def salespeople(sales: Sales) -> DataFrame:
    names = ("ids", *MONEY_SUMS, "discount", "discount_rows", "losses", "orders")
    groups = sales.summed(["salesperson", "payment_status"], names)
    groups = groups.filter(F.col("salesperson").isNotNull())
    people = added(groups, ["salesperson"], names, overdue("orders").alias("overdue_orders"))
    people = people.fillna(0, list(MONEY_SUMS))
    return people.select(
        "salesperson",
        F.col("ids").alias("orders"),
        amount("net_sales"),
        amount("profit"),
        mean("discount", "discount_rows").alias("avg_discount_pct"),
        F.col("losses").alias("loss_orders"),
        "overdue_orders",
        margin(),
    ).orderBy(F.desc("net_sales"), "salesperson")


def _over_domain(sales: Sales, groups: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """One row per fixed value, also for those without orders, in the fixed order."""
    domain = literal_rows(sales.customers.sparkSession, ("place", key), list(enumerate(values)))
    return domain.join(groups, key, "left")


def payment_status(sales: Sales) -> DataFrame:
    groups = sales.summed(["payment_status"], ("ids", "net_sales")).fillna(0, ["net_sales"])
    groups = groups.withColumnRenamed("ids", "orders")
    rows = _over_domain(sales, groups, "payment_status", STATUSES)
    share = percent("net_sales", overall("net_sales")).alias("share_pct")
    return (
        rows.select("place", "payment_status", "orders", amount("net_sales"), share)
        .orderBy("place")
        .drop("place")
    )


def overdue_customers(sales: Sales, n: int = 10) -> DataFrame:
    people = per_customer(sales, ("net_sales",), frame=True, status="Overdue")
    people = people.filter(F.col("customer_id").isNotNull())
    return largest(people, "net_sales", n, "customer_id").select(
        "customer_id",
        "customer_name",
        "city",
        F.col("orders").alias("overdue_orders"),
        amount("net_sales", "overdue_amount"),
    )


def discount_bands(sales: Sales) -> DataFrame:
    names = ("ids", *MONEY_SUMS, "losses")
    values = sales.summed(["discount_pct"], names)
    bands = values.withColumn("discount_band", band_by_bins(F.col("discount_pct")))
    groups = added(bands, ["discount_band"], names).fillna(0, list(MONEY_SUMS))
    groups = groups.withColumnsRenamed({"ids": "orders", "losses": "loss_orders"})
    rows = _over_domain(sales, groups, "discount_band", BANDS)
    return (
        rows.select(
            "place",
            "discount_band",
            "orders",
            amount("net_sales"),
            amount("profit"),
            "loss_orders",
            margin(),
        )
        .orderBy("place")
        .drop("place")
    )


def discount_margin_correlation(sales: Sales) -> DataFrame:
    """Pearson correlation of discount and rounded order margin, to three decimals."""
    lines = sales.facts("discount_pct", "profit_margin_pct")
    return lines.agg(
        F.round(F.corr(dbl("discount_pct"), "profit_margin_pct"), 3).alias("correlation")
    )


def loss_summary(sales: Sales) -> DataFrame:
    lines = sales.facts("is_loss", "profit", "discount_pct")
    loss = F.when(F.col("is_loss"), F.col("discount_pct"))
    one = lines.agg(
        F.count_if("is_loss").alias("loss_orders"),
        F.coalesce(-F.sum(F.when(F.col("is_loss"), F.col("profit"))), F.lit(0)).alias("total_loss"),
        F.sum(loss).alias("loss_discount"),
        F.count(loss).alias("loss_rows"),
        F.sum("discount_pct").alias("discount"),
        F.count("discount_pct").alias("rows"),
    )
    return one.select(
        "loss_orders",
        amount("total_loss"),
        mean("loss_discount", "loss_rows").alias("avg_discount_loss"),
        mean("discount", "rows").alias("avg_discount_all"),
    )


def loss_by_category(sales: Sales) -> DataFrame:
    lines = sales.facts("product_id", "order_id", "is_loss", "profit").filter("is_loss")
    per_id = summed(lines, ["product_id"], ("ids", "profit")).withColumnRenamed("ids", "orders")
    master = sales.products.select("product_id", "category")
    return (
        again(per_id.fillna(0, ["profit"]).join(master, "product_id"), ["category"])
        .filter(F.col("category").isNotNull())
        .select("category", "orders", amount("profit", "loss"))
        .orderBy("loss", "category")
    )


def quarters(sales: Sales) -> DataFrame:
    return (
        sales.summed(["quarter"], ("ids", *MONEY_SUMS))
        .filter(F.col("quarter").isNotNull())
        .fillna(0, list(MONEY_SUMS))
        .select(
            F.concat(F.lit("Q"), "quarter").alias("quarter"),
            F.col("ids").alias("orders"),
            amount("net_sales"),
            amount("profit"),
            margin(),
        )
        .orderBy("quarter")
    )
