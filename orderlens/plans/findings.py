"""The figures behind the written findings of the management summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.columns import dbl, percent
from orderlens.operators.quality import duplicate_ids
from orderlens.plans.frame_reports import mean
from orderlens.plans.parts import (
    amount,
    largest,
    overall,
    overdue,
    per_customer,
    per_product,
)
from orderlens.plans.sql_reports import MONEY_SUMS, monthly_totals
from orderlens.warehouse import Sales


def receivables(sales: Sales) -> DataFrame:
    status = F.col("payment_status")

    def part(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(status.isin(*names), F.col("net_sales"))), F.lit(0))

    one = sales.summed(["payment_status"], ("orders", "net_sales")).agg(
        part("Pending", "Overdue").alias("uncollected"),
        part("Pending").alias("pending"),
        part("Overdue").alias("overdue"),
        overdue("orders").alias("overdue_orders"),
        F.sum("net_sales").alias("net_sales"),
    )
    return one.select(
        amount("uncollected", "uncollected_amount"),
        percent("uncollected", "net_sales").alias("uncollected_share_pct"),
        amount("pending", "pending_amount"),
        amount("overdue", "overdue_amount"),
        "overdue_orders",
    )


def discount_share(sales: Sales) -> DataFrame:
    one = sales.summed([], ("gross_sales", "discount_amount"))
    return one.select(
        amount("gross_sales"),
        amount("discount_amount"),
        percent("discount_amount", "gross_sales").alias("discount_share_pct"),
    )


def best_worst_month(sales: Sales) -> DataFrame:
    """Of two equal months the later is best, the earlier worst."""
    before = F.lag("net_sales").over(W.orderBy("year_month"))
    months = (
        monthly_totals(sales)
        .filter(F.col("year_month").isNotNull())
        .withColumn("before", before)
        .withColumn("rank_key", F.struct("net_sales", "year_month"))
    )
    row = F.struct("year_month", "net_sales", "before")
    one = months.agg(
        F.max_by(row, "rank_key").alias("best"), F.min_by(row, "rank_key").alias("worst")
    )
    fall = F.col("worst.net_sales") - F.col("worst.before")
    return one.select(
        F.col("best.year_month").alias("best_month"),
        amount("best.net_sales", "best_net_sales"),
        F.col("worst.year_month").alias("worst_month"),
        amount("worst.net_sales", "worst_net_sales"),
        percent(fall, "worst.before").alias("worst_change_pct"),
    )


def hidden_problem_products(sales: Sales, top: int = 10, below: float = 15.0) -> DataFrame:
    """Products among the ``top`` by sales whose margin is under ``below`` percent."""
    place = F.rank().over(W.orderBy(F.col("net_sales").desc_nulls_last()))
    return (
        per_product(sales, MONEY_SUMS)
        .withColumn("sales_rank", place)
        .filter(F.col("sales_rank") <= top)
        .select(
            "product_id",
            "product_name",
            "category",
            amount("net_sales"),
            "sales_rank",
            percent("profit", "net_sales").alias("margin_pct"),
        )
        .filter(F.col("margin_pct") < below)
        .orderBy("sales_rank", "product_id")
    )


def loss_vs_threshold(sales: Sales, threshold: int = 10) -> DataFrame:
    """How many loss-making orders have a discount above the threshold."""
    loss, discount = F.col("is_loss"), F.col("discount_pct")
    one = sales.facts("is_loss", "discount_pct").agg(
        F.count_if(loss).alias("loss_orders"),
        F.count_if(loss & (discount > threshold)).alias("loss_above"),
        F.sum(F.when(loss, discount)).alias("discount"),
        F.count(F.when(loss, discount)).alias("rows"),
    )
    return one.select(
        "loss_orders",
        F.col("loss_above").alias("loss_orders_above_threshold"),
        percent("loss_above", "loss_orders").alias("share_above_pct"),
        mean("discount", "rows").alias("avg_discount_loss"),
    )


def largest_loss(sales: Sales) -> DataFrame:
    """The order with the lowest profit (of equal ones the first id)."""
    row = F.struct("profit", "order_id", "discount_pct", "net_sales")
    lines = sales.facts("order_id", "discount_pct", "net_sales", "profit")
    lines = lines.filter(F.col("profit") < 0)
    return (
        lines.agg(F.min(row).alias("worst"))
        .filter(F.col("worst").isNotNull())
        .select(
            F.col("worst.order_id").alias("order_id"),
            amount("worst.discount_pct", "discount_pct"),
            amount("worst.net_sales", "net_sales"),
            amount("worst.profit", "profit"),
        )
    )


def overdue_concentration(sales: Sales, top: int = 10) -> DataFrame:
    """Share of the ``top`` customers in all overdue sales. Both sums stand on the same
    totals per customer, so Spark computes those once."""
    people = sales.summed(["customer_id"], ("net_sales",), {"payment_status": "Overdue"})
    everything = people.agg(F.sum("net_sales")).scalar()
    one = largest(people, "net_sales", top, "customer_id").agg(F.sum("net_sales").alias("top"))
    one = one.select("top", everything.alias("everything"))
    return one.select(
        amount("top", "top_overdue_amount"),
        amount("everything", "overdue_amount"),
        percent("top", "everything").alias("top_share_pct"),
    )


def _leader_rows(*rows: tuple[str, Column, Column]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(t).alias("finding"), n.alias("name"), dbl(v).alias("value"))
                for t, n, v in rows
            ]
        )
    )


def _first(name: str, value: Column) -> Column:
    """Name and value of the row with the greatest value; of equal rows the first name.

    The kept pair is the minimum of (-value, name), so no sort is planned.
    """
    return F.min(F.when(value.isNotNull(), F.struct((-value).alias("v"), F.col(name).alias("n"))))


def leaders(sales: Sales) -> DataFrame:
    """Leading salesperson, city and customer type, most overdue orders, lowest margin."""
    lines = sales.facts("salesperson", *MONEY_SUMS, "payment_status")
    people = (
        lines.filter(F.col("salesperson").isNotNull())
        .groupBy("salesperson")
        .agg(
            F.sum("net_sales").alias("net_sales"),
            F.sum("profit").alias("profit"),
            F.count_if(F.col("payment_status") == "Overdue").alias("overdue"),
        )
    )
    person_margin = percent("profit", "net_sales")
    one = people.agg(
        _first("salesperson", dbl("net_sales")).alias("sales"),
        _first("salesperson", dbl("overdue")).alias("overdue"),
        _first("salesperson", -person_margin).alias("margin"),
        F.sum("net_sales").alias("everything"),
    )
    people_rows = one.select(
        _leader_rows(
            ("Top salesperson by sales", F.col("sales.n"), -F.col("sales.v")),
            (
                "Top salesperson, share of sales (%)",
                F.col("sales.n"),
                percent(-F.col("sales.v"), "everything"),
            ),
            ("Most overdue orders", F.col("overdue.n"), -F.col("overdue.v")),
            ("Lowest margin (%)", F.col("margin.n"), F.col("margin.v")),
        )
    )
    places = per_customer(sales, ("net_sales",)).groupBy("city", "customer_type")
    places = places.agg(F.sum("net_sales").alias("net_sales"))

    def top(attribute: str, text: str) -> DataFrame:
        groups = places.groupBy(attribute).agg(F.sum("net_sales").alias("net_sales"))
        first = groups.agg(
            _first(attribute, dbl("net_sales")).alias("top"),
            F.sum("net_sales").alias("everything"),
        )
        return first.select(
            _leader_rows(
                (f"{text} by sales", F.col("top.n"), -F.col("top.v")),
                (
                    f"{text}, share of sales (%)",
                    F.col("top.n"),
                    percent(-F.col("top.v"), "everything"),
                ),
            )
        )

    return people_rows.unionByName(top("city", "Top city")).unionByName(
        top("customer_type", "Top customer type")
    )


def scope_counts(sales: Sales) -> DataFrame:
    """Distinct orders, customers, products, salespeople and cities in the cleaned orders.

    An unknown id is a customer here; ``known_customers`` and ``cities`` leave it out. Keys that
    reports sum by are counted from those sums; orders are the present ids less the repeats.
    """
    ids = sales.summed(["customer_id"], ("orders",)).select("customer_id")
    master = sales.customers.select("customer_id", "city", F.lit(True).alias("known"))
    people = ids.join(master, "customer_id", "left").agg(
        F.count("customer_id").alias("customers"),
        F.count("known").alias("known_customers"),
        F.countDistinct("city").alias("cities"),
    )
    products = sales.products.select("product_id")

    def number(groups: DataFrame, key: str) -> Column:
        return groups.agg(F.count(key)).scalar()

    again = duplicate_ids(sales.facts("order_id")).filter(F.col("order_id").isNotNull())
    repeats = again.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0))).scalar()
    present = sales.summed([], ("ids",)).select("ids").scalar()
    return people.select(
        (present - repeats).alias("orders"),
        "customers",
        number(sales.summed(["product_id"], ("orders",)).join(products, "product_id", "left_semi"), "product_id").alias("products"),
        number(sales.summed(["salesperson"], ("orders",)), "salesperson").alias("salespeople"),
        "known_customers",
        "cities",
    )


def below_average_categories(sales: Sales) -> DataFrame:
    rows = sales.summed(["category"], MONEY_SUMS).select(
        "category",
        percent("profit", "net_sales").alias("margin_pct"),
        percent(overall("profit"), overall("net_sales")).alias("overall_margin_pct"),
    )
    below = F.col("category").isNotNull() & (F.col("margin_pct") < F.col("overall_margin_pct"))
    return rows.filter(below).orderBy("margin_pct", "category")


def slow_months(sales: Sales) -> DataFrame:
    """Months below the mean of all months. The rule is ours: the summary names slow months
    without one."""
    months = monthly_totals(sales).filter(F.col("year_month").isNotNull())
    whole = W.partitionBy()
    average = F.try_divide(
        dbl(F.sum("net_sales").over(whole)), dbl(F.count("net_sales").over(whole))
    )
    return (
        months.select("year_month", amount("net_sales"), average.alias("average_net_sales"))
        .filter(F.col("net_sales") < F.col("average_net_sales"))
        .orderBy("year_month")
    )
