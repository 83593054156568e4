"""Table schemas and fixed value domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_MONEY = T.DecimalType(18, 4)
MONEY = T.DecimalType(18, 2)
PERCENT = T.DecimalType(6, 2)

# Fixed values that results must equal: names and order of the columns.
MONEY_COLUMNS = (
    "unit_cost",
    "selling_price",
    "gross_sales",
    "discount_amount",
    "net_sales",
    "cost",
    "profit",
)


def _order_fields(money: T.DataType) -> list[T.StructField]:
    head = [
        ("order_id", T.StringType()),
        ("order_date", T.DateType()),
        ("customer_id", T.StringType()),
        ("product_id", T.StringType()),
        ("quantity", T.IntegerType()),
        ("discount_pct", PERCENT),
        ("payment_status", T.StringType()),
        ("salesperson", T.StringType()),
    ]
    return [T.StructField(n, t) for n, t in head + [(m, money) for m in MONEY_COLUMNS]]


ORDERS_RAW = T.StructType(_order_fields(RAW_MONEY))
ORDERS = T.StructType(_order_fields(MONEY))
CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("join_date", T.DateType()),
    ]
)
PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)
ORDER_COLUMNS = tuple(ORDERS_RAW.names)
CUSTOMER_TEXT = ("customer_name", "city", "customer_type")

# The cleaned wide table, in export order.
CLEAN_COLUMNS = (
    "order_id", "order_date", "year_month", "order_month_num", "order_month", "quarter",
    "customer_id", "customer_name", "city", "customer_type",
    "product_id", "product_name", "category", "salesperson", "payment_status",
    "quantity", "unit_cost", "selling_price", "discount_pct", "discount_band",
    "gross_sales", "discount_amount", "net_sales", "cost", "profit", "profit_margin_pct",
    "is_loss", "unknown_customer", "discount_outlier",
)

# Fixed values that results must equal.
STATUSES = ("Paid", "Pending", "Overdue")
BANDS = ("0%", "1-5%", "6-10%", ">10%")
UNKNOWN = "Unknown"
MONEY_TOLERANCE = "0.01"
OUTLIER_DISCOUNT = 20


def literal_rows(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A small constant table, built on the JVM side; a value may also be a Column."""
    structs = [
        F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in zip(names, row)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
