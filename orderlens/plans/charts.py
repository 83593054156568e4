"""The series the seven charts draw, with their axis or bar texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import lakh_label
from orderlens.plans import frame_reports as frame
from orderlens.warehouse import Sales


def _percent_text(column: str, before: str = "") -> Column:
    text = F.format_string(f"{before}%.1f%%", F.round(column, 1))
    return F.when(F.col(column).isNotNull(), text)


def monthly_trend(sales: Sales) -> DataFrame:
    return frame.monthly(sales).select(
        "order_month_num", "order_month", "net_sales", "profit",
        lakh_label(F.col("net_sales")).alias("axis_label"),
    )


def category(sales: Sales) -> DataFrame:
    return frame.category(sales).select(
        "category", "net_sales", "profit", _percent_text("margin_pct", "margin ").alias("bar_label")
    )


def top_products(sales: Sales) -> DataFrame:
    return frame.top_products(sales).select("product_name", "net_sales")


def city_customer_type(sales: Sales) -> DataFrame:
    """Two panels in one long table."""
    panels = [
        df.select(F.lit(key).alias("panel"), F.col(key).alias("label"), "net_sales")
        for key, df in (
            ("city", frame.city(sales)),
            ("customer_type", frame.customer_type(sales)),
        )
    ]
    return panels[0].unionByName(panels[1])


def salesperson(sales: Sales) -> DataFrame:
    return frame.salespeople(sales).select("salesperson", "net_sales", "profit")


def payment_status(sales: Sales) -> DataFrame:
    return frame.payment_status(sales).select(
        "payment_status", "net_sales", _percent_text("share_pct").alias("slice_label")
    )


def discount_margin(sales: Sales) -> DataFrame:
    return frame.discount_bands(sales).select(
        "discount_band", "margin_pct", _percent_text("margin_pct").alias("bar_label")
    )
