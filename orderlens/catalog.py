"""Every query by name, as a function of the sales tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators import cleaning, profiling, quality, validation
from orderlens.plans import charts, dashboard, findings, frame_reports, sql_reports
from orderlens.schema import CUSTOMERS, MONEY_COLUMNS, ORDER_COLUMNS, PRODUCTS
from orderlens.warehouse import Sales

# Years the supplied orders should lie in; the selection shown by ``kpi_filtered``.
EXPECTED_YEARS = (1995, 2000)
SLICE = {"salesperson": "Supplier#000000001", "category": "ECONOMY"}

Report = Callable[[Sales], DataFrame]


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, decimals as double: the types any SQL client shows alike."""
    columns = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(field.dataType, T.FractionalType):
            value = value.cast("double")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _checked(rule) -> Report:
    """A rule over the orders as delivered and both masters with the expected years."""
    return lambda s: rule(s.deliveries(), s.customers, s.products, EXPECTED_YEARS, s.deliveries("discount_pct"))


def _ids(condition, *columns: str) -> Report:
    return lambda s: quality.ids_where(s.raw("order_id", *columns), condition())


def _counts(table: str, column: str) -> Report:
    if table == "orders":
        return lambda s: profiling.value_counts(s.raw(column), column)
    return lambda s: profiling.value_counts(getattr(s, table), column)


SOURCES: dict[str, Report] = {
    "shape_report": lambda s: profiling.shape_report(
        {
            "Orders": (s.raw("order_id"), len(ORDER_COLUMNS)),
            "Customers": (s.customers, len(CUSTOMERS)),
            "Products": (s.products, len(PRODUCTS)),
        }
    ),
    "preview": lambda s: profiling.preview(s.raw(), s.raw("order_id"), "order_id"),
    "preview_clean": lambda s: profiling.preview(s.clean(), s.facts("order_id"), "order_id"),
    "preview_customers": frame_reports.first_customers,
    "profile_nulls": lambda s: profiling.profile_nulls(s.raw()),
    "describe_numeric": lambda s: profiling.describe_numeric(s.raw()),
    "value_counts_payment_status": _counts("orders", "payment_status"),
    "value_counts_salesperson": _counts("orders", "salesperson"),
    "value_counts_customer_type": _counts("customers", "customer_type"),
    "value_counts_city": _counts("customers", "city"),
    "value_counts_category": _counts("products", "category"),
    "date_range": lambda s: profiling.date_range(s.raw("order_date")),
}

QUALITY: dict[str, Report] = {
    "dq_missing": lambda s: quality.ids_where(s.raw(), quality.has_missing(s.raw().columns)),
    "dq_dup_id": lambda s: quality.repeated_ids(s.deliveries("order_id")),
    "dq_dup_row": lambda s: quality.repeated_rows(s.deliveries()),
    "dq_bad_status": _ids(quality.bad_status, "payment_status"),
    "dq_qty": lambda s: quality.ids_where(s.raw("order_id", "quantity"), F.col("quantity") <= 0),
    "dq_iqr_outlier": lambda s: quality.iqr_outliers(s.raw("order_id", "discount_pct")),
    "dq_orphan_customer": lambda s: quality.missing_in(
        s.raw("order_id", "customer_id"), s.customers, "customer_id"
    ),
    "dq_orphan_product": lambda s: quality.missing_in(
        s.raw("order_id", "product_id"), s.products, "product_id"
    ),
    "dq_gross": _ids(quality.gross_differs, "quantity", "selling_price", "gross_sales"),
    "dq_net": _ids(quality.net_differs, "gross_sales", "discount_amount", "net_sales"),
    "dq_profit": _ids(quality.profit_differs, "net_sales", "cost", "profit"),
    "dq_cost": _ids(quality.cost_differs, "quantity", "unit_cost", "cost"),
    "dq_date_range": _ids(lambda: quality.outside_years(*EXPECTED_YEARS), "order_date"),
    "dq_violations": _checked(quality.violations),
    "dq_summary": _checked(quality.summary),
    "dq_id_pages": _checked(quality.id_pages),
    "dq_affected_rows": _checked(quality.affected_rows),
    "dq_row_counts": lambda s: cleaning.row_counts(s.raw("product_id", "quantity"), s.products),
    "dq_orphans": lambda s: quality.orphans(
        s.raw("order_id", "customer_id", "product_id"), s.customers, s.products
    ),
    "dq_invalid_values": lambda s: quality.invalid_values(
        s.raw("order_id", "quantity", "discount_pct", "net_sales")
    ),
    "dq_status_spelling": lambda s: quality.status_spelling(s.raw("payment_status")),
    "dq_duplicate_ids": lambda s: quality.duplicate_ids(s.deliveries("order_id")),
}

CLEANING: dict[str, Report] = {
    "clean_text": lambda s: cleaning.clean_text(
        s.raw("order_id", "payment_status", "salesperson")
    ),
    "clean_drop_orphan_product": lambda s: cleaning.drop_orphan_product(s.raw(), s.products),
    "clean_drop_bad_qty": lambda s: cleaning.drop_bad_quantity(s.raw()),
    "flag_unknown_customer": lambda s: cleaning.mark_unknown_customer(
        s.raw("order_id", "customer_id"), s.customers
    ),
    "flag_discount_outlier": lambda s: s.facts("order_id", "discount_pct", "discount_outlier"),
    "cleaning_log": lambda s: cleaning.cleaning_log(s.raw("product_id", "quantity"), s.products),
    "enrich": lambda s: cleaning.enrich(
        s.raw("order_id", "customer_id", "product_id"), s.customers, s.products
    ),
    "derived_columns": lambda s: s.facts(
        "order_id", "year_month", "order_month_num", "order_month", "quarter",
        "profit_margin_pct", "is_loss", "discount_band",
    ),
    "rounded_money": lambda s: s.facts("order_id", *MONEY_COLUMNS),
    "clean": lambda s: s.clean(),
    "validate_unique": lambda s: validation.unique_ids(s.facts("order_id")),
    "validate_money": lambda s: validation.money_present(s.facts(*MONEY_COLUMNS)),
    "validate_qty": lambda s: validation.quantity_positive(s.facts("quantity")),
    "validate_status": lambda s: validation.status_set(s.facts("payment_status")),
    "validate_product_fk": lambda s: validation.products_known(s.facts("product_id"), s.products),
    "validate_summary": lambda s: cleaning.cleaning_summary(
        s.raw("product_id", "quantity"), s.products
    ),
}

SQL_REPORTS: dict[str, Report] = {
    "kpi_headline": sql_reports.headline,
    "monthly_trend": sql_reports.monthly_trend,
    "quarterly": sql_reports.quarterly,
    "category_perf": sql_reports.category_performance,
    "top_products": sql_reports.top_products,
    "bottom_margin_products": sql_reports.bottom_margin_products,
    "best_product_per_category": sql_reports.best_product_per_category,
    "city_sales": sql_reports.city_sales,
    "customer_type_sales": sql_reports.customer_type_sales,
    "top_customers": sql_reports.top_customers,
    "salesperson_rank": sql_reports.salesperson_rank,
    "payment_status_summary": sql_reports.payment_status_summary,
    "top_overdue_customers": sql_reports.top_overdue_customers,
    "discount_band_margin": sql_reports.discount_band_margin,
    "loss_orders": sql_reports.loss_orders,
}

FRAME_REPORTS: dict[str, Report] = {
    "kpi_full": frame_reports.kpi_full,
    "monthly_by_month_num": frame_reports.monthly,
    "category_perf_df": frame_reports.category,
    "top10_products": frame_reports.top_products,
    "bottom5_margin_df": frame_reports.bottom_margin_products,
    "city_perf": frame_reports.city,
    "customer_type_perf": frame_reports.customer_type,
    "customer_perf": frame_reports.customers,
    "pareto_top20": frame_reports.pareto,
    "salesperson_perf": frame_reports.salespeople,
    "payment_status_domain": frame_reports.payment_status,
    "overdue_customers_df": frame_reports.overdue_customers,
    "discount_band_df": frame_reports.discount_bands,
    "discount_margin_corr": frame_reports.discount_margin_correlation,
    "loss_summary": frame_reports.loss_summary,
    "loss_by_category": frame_reports.loss_by_category,
    "quarterly_df": frame_reports.quarters,
}

FINDINGS: dict[str, Report] = {
    "receivables": findings.receivables,
    "discount_share_of_gross": findings.discount_share,
    "best_worst_month": findings.best_worst_month,
    "hidden_problem_products": findings.hidden_problem_products,
    "loss_vs_threshold": findings.loss_vs_threshold,
    "largest_loss_order": findings.largest_loss,
    "overdue_concentration": findings.overdue_concentration,
    "leaders": findings.leaders,
    "scope_counts": findings.scope_counts,
    "below_avg_categories": findings.below_average_categories,
    "slow_months": findings.slow_months,
    "dashboard_cube": dashboard.cube,
    "kpi_filtered": lambda s: sql_reports.headline(dashboard.Selection(s, **SLICE)),
    "chart_monthly_trend_filtered": lambda s: charts.monthly_trend(
        dashboard.Selection(s, category=SLICE["category"])
    ),
    "chart_city_customer_type_filtered": lambda s: charts.city_customer_type(
        dashboard.Selection(s, salesperson=SLICE["salesperson"])
    ),
    "chart_discount_margin_filtered": lambda s: charts.discount_margin(
        dashboard.Selection(s, **SLICE)
    ),
}

CHARTS: dict[str, Report] = {
    "chart_monthly_trend": charts.monthly_trend,
    "chart_category": charts.category,
    "chart_top_products": charts.top_products,
    "chart_city_customer_type": charts.city_customer_type,
    "chart_salesperson": charts.salesperson,
    "chart_payment_status": charts.payment_status,
    "chart_discount_margin": charts.discount_margin,
}

REPORTS: dict[str, Report] = {
    **SOURCES,
    **QUALITY,
    **CLEANING,
    **SQL_REPORTS,
    **FRAME_REPORTS,
    **FINDINGS,
    **CHARTS,
}


def run(name: str, sales: Sales) -> DataFrame:
    return plain_types(REPORTS[name](sales))
