"""Cleaning, enrichment and derived columns.

Each step works on whatever order columns are present, so a report that needs three
columns plans only those three.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import (
    band_by_bins,
    clean_status,
    money,
    month_name,
    or_false,
    order_margin,
    quarter_label,
    strip_title,
    year_month,
)
from orderlens.schema import (
    CLEAN_COLUMNS,
    CUSTOMER_TEXT,
    MONEY_COLUMNS,
    OUTLIER_DISCOUNT,
    UNKNOWN,
)

TEXT_CLEANERS = {"payment_status": clean_status, "salesperson": strip_title}


# Derived column -> (order columns it needs, expression).
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "year_month": (("order_date",), lambda: year_month(F.col("order_date"))),
    "order_month_num": (("order_date",), lambda: F.month("order_date")),
    "order_month": (("order_date",), lambda: month_name(F.col("order_date"))),
    "quarter": (("order_date",), lambda: quarter_label(F.col("order_date"))),
    "profit_margin_pct": (
        ("profit", "net_sales"),
        lambda: order_margin(F.col("profit"), F.col("net_sales")),
    ),
    "is_loss": (("profit",), lambda: or_false(F.col("profit") < 0)),
    "discount_band": (("discount_pct",), lambda: band_by_bins(F.col("discount_pct"))),
    "discount_outlier": (
        ("discount_pct",),
        lambda: or_false(F.col("discount_pct") > OUTLIER_DISCOUNT),
    ),
}


def inputs_of(columns: Iterable[str]) -> set[str]:
    """The raw order columns needed for these cleaned columns, with those of the removals."""
    needed = {"product_id", "quantity"}
    for name in columns:
        needed.update(FEATURES[name][0] if name in FEATURES else (name,))
    return needed


def clean_text(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {c: f(F.col(c)) for c, f in TEXT_CLEANERS.items() if c in orders.columns}
    )


def bad_quantity() -> Column:
    """Zero or less; a missing quantity is kept."""
    return or_false(F.col("quantity") <= 0)


def drop_orphan_product(orders: DataFrame, products: DataFrame) -> DataFrame:
    return orders.join(products.select("product_id"), "product_id", "left_semi").select(
        *orders.columns
    )


def drop_bad_quantity(orders: DataFrame) -> DataFrame:
    return orders.filter(~bad_quantity())


def mark_unknown_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    known = customers.select("customer_id", F.lit(True).alias("_known"))
    return (
        orders.join(known, "customer_id", "left")
        .withColumn("unknown_customer", F.col("_known").isNull())
        .select(*orders.columns, "unknown_customer")
    )


def derive(orders: DataFrame, names: Iterable[str] = tuple(FEATURES)) -> DataFrame:
    """Add derived columns and round money in one projection: margin and loss flag see the
    money as it came, before rounding."""
    rounded = [
        money(F.col(c)).alias(c) if c in MONEY_COLUMNS else F.col(c) for c in orders.columns
    ]
    return orders.select(*rounded, *[FEATURES[n][1]().alias(n) for n in names])


def clean_lines(raw: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The asked columns of the cleaned order lines, those of unknown products among them.
    ``raw`` needs the columns that ``inputs_of`` names."""
    derived = [c for c in columns if c in FEATURES]
    return derive(clean_text(drop_bad_quantity(raw)), derived).select(*columns)


def clean_orders(raw: DataFrame, products: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The asked columns of the cleaned order lines, without master attributes."""
    return clean_lines(drop_orphan_product(raw, products), columns)


def add_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join of the customer attributes. Unmatched ids, and missing attributes of known
    customers, read ``Unknown``; only unmatched ids set ``unknown_customer``."""
    master = customers.select("customer_id", *CUSTOMER_TEXT, F.lit(True).alias("_known"))
    return (
        orders.join(master, "customer_id", "left")
        .withColumn("unknown_customer", F.col("_known").isNull())
        .drop("_known")
        .fillna(UNKNOWN, list(CUSTOMER_TEXT))
    )


# What ``add_customer`` adds.
CUSTOMER_COLUMNS = (*CUSTOMER_TEXT, "unknown_customer")


def unknown_customers(orders: DataFrame) -> DataFrame:
    """Orders with the columns of ``add_customer``; where those are missing, the customer is unknown."""
    return orders.fillna(UNKNOWN, list(CUSTOMER_TEXT)).fillna(True, ["unknown_customer"])


def add_product(orders: DataFrame, products: DataFrame, how: str = "left") -> DataFrame:
    return orders.join(products.select("product_id", "product_name", "category"), "product_id", how)


def enrich(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    return add_product(add_customer(orders, customers), products)


def build_clean(raw: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """The wide cleaned table. The inner join with the (unique) product master both drops
    orphan products and brings their attributes, so the lines meet each master once. Columns are
    derived behind the joins, which then shuffle the lines without them."""
    return finish_clean(add_customer(add_product(drop_bad_quantity(raw), products, "inner"), customers))


def clean_with_customers(orders: DataFrame, products: DataFrame) -> DataFrame:
    """``build_clean`` of raw orders that have the columns of ``add_customer`` already."""
    return finish_clean(add_product(drop_bad_quantity(orders), products, "inner"))


def finish_clean(joined: DataFrame) -> DataFrame:
    return derive(clean_text(joined)).select(*CLEAN_COLUMNS)


# Why a row is not in the cleaned table; a row with both faults has the first.
UNKNOWN_PRODUCT = "unknown_product"
BAD_QUANTITY = "bad_quantity"
KEPT = "none"


def build_marked(raw: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """``build_clean`` before rows go: every raw row, with the reason for its removal."""
    known = products.select("product_id", "product_name", "category", F.lit(True).alias("_product"))
    reason = (
        F.when(F.col("_product").isNull(), UNKNOWN_PRODUCT).when(bad_quantity(), BAD_QUANTITY).otherwise(KEPT)
    )
    marked = raw.join(known, "product_id", "left").withColumn("removed_for", reason).drop("_product")
    return derive(clean_text(add_customer(marked, customers))).select(*CLEAN_COLUMNS, "removed_for")


def removal_counts(raw: DataFrame, products: DataFrame) -> DataFrame:
    """One row: all rows, rows with an unknown product, other rows with a bad quantity.

    Counted per product id before the join with the master, so a hot product is one row
    per task in the shuffle.
    """
    per_product = raw.groupBy("product_id").agg(
        F.count("*").alias("rows"), F.count_if(bad_quantity()).alias("bad")
    )
    known = products.select("product_id", F.lit(True).alias("_known"))
    orphan = F.col("_known").isNull()
    return per_product.join(known, "product_id", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
        F.coalesce(F.sum(F.when(~orphan, F.col("bad"))), F.lit(0)).alias("bad_quantity_rows"),
    )


# Fixed texts of the cleaning log.
LOG_STEPS = (
    "Standardised payment_status / salesperson text",
    "Removed orders with unknown product_id (missing financials)",
    "Removed orders with quantity <= 0",
)


def log_rows(counts: DataFrame) -> DataFrame:
    """The log from one row with ``orphan_rows`` and ``bad_quantity_rows``."""
    removed = (F.lit(0).cast("bigint"), F.col("orphan_rows"), F.col("bad_quantity_rows"))
    rows = [
        F.struct(F.lit(step).alias("step"), n.alias("rows_removed"))
        for step, n in zip(LOG_STEPS, removed)
    ]
    return counts.select(F.inline(F.array(*rows)))


def cleaning_log(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Rows removed per step. A row with both faults counts under the first."""
    return log_rows(removal_counts(raw, products))


def removal_metrics() -> list[Column]:
    """The counts of the log over the rows of ``build_marked``, for ``DataFrame.observe``."""
    reason = F.col("removed_for")
    return [
        F.count("*").alias("raw_rows"),
        F.count_if(reason == UNKNOWN_PRODUCT).alias("orphan_rows"),
        F.count_if(reason == BAD_QUANTITY).alias("bad_quantity_rows"),
    ]


def cleaning_summary(raw: DataFrame, products: DataFrame) -> DataFrame:
    gone = F.col("orphan_rows") + F.col("bad_quantity_rows")
    return removal_counts(raw, products).select(
        "raw_rows", (F.col("raw_rows") - gone).alias("clean_rows"), gone.alias("removed_rows")
    )


def row_counts(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Raw against cleaned row counts, from one pass over the raw lines."""
    rows = [
        F.struct(F.lit(name).alias("table_name"), F.col(c).alias("row_count"))
        for name, c in (("orders_raw", "raw_rows"), ("orders", "clean_rows"))
    ]
    return cleaning_summary(raw, products).select(F.inline(F.array(*rows)))
