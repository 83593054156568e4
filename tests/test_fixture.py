"""Hand-derived results on eight orders with one planted fault each."""

from datetime import date

import pytest

from orderlens import catalog
from orderlens.operators import cleaning, profiling, quality, validation
from orderlens.plans import dashboard, findings, frame_reports, sql_reports

YEAR = (2025, 2025)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def ids(df):
    return sorted(r.order_id for r in df.collect())


def close(found, expected):
    assert len(found) == len(expected)
    for one, other in zip(found, expected):
        assert one == pytest.approx(other, abs=0.006, nan_ok=False) if not isinstance(
            one, tuple
        ) else [
            v == pytest.approx(w, abs=0.006) if isinstance(w, float) else v == w
            for v, w in zip(one, other)
        ] == [True] * len(other)


def test_single_rules(sales):
    raw = sales.raw()
    assert ids(quality.ids_where(raw, quality.has_missing(raw.columns[:-7]))) == []
    assert ids(quality.ids_where(raw, quality.has_missing(raw.columns))) == ["O6"]
    assert ids(quality.repeated_ids(raw)) == []
    assert ids(quality.repeated_rows(raw)) == []
    assert ids(quality.ids_where(raw, quality.bad_status())) == ["O5"]
    assert ids(quality.missing_in(raw, sales.customers, "customer_id")) == ["O5"]
    assert ids(quality.missing_in(raw, sales.products, "product_id")) == ["O6"]
    for rule in (quality.gross_differs, quality.net_differs, quality.profit_differs):
        assert ids(quality.ids_where(raw, rule())) == []
    assert ids(quality.ids_where(raw, quality.cost_differs())) == []
    assert ids(quality.ids_where(raw, quality.outside_years(*YEAR))) == ["O8"]


def test_fence(sales):
    assert rows(quality.iqr_fence(sales.raw())) == [(0.0, 6.25, 15.625)]
    assert ids(quality.iqr_outliers(sales.raw())) == ["O4"]


def test_quality_log(sales):
    log = rows(quality.summary(sales.raw(), sales.customers, sales.products, YEAR))
    found = {r[1]: r[2] for r in log}
    assert [r[0] for r in log] == list(range(1, 13))
    assert found == {
        "Missing values (any column)": 1,
        "Duplicate order_id": 0,
        "Fully duplicated rows": 0,
        "Invalid payment_status spelling/case": 1,
        "Quantity <= 0": 1,
        "Discount outlier (> 16% IQR fence)": 1,
        "customer_id not in Customers": 1,
        "product_id not in Products": 1,
        "gross_sales != qty x price": 0,
        "net_sales != gross - discount": 0,
        "profit != net - cost": 0,
        "Order date outside 2025": 1,
    }
    pages = rows(quality.id_pages(sales.raw(), sales.customers, sales.products, YEAR))
    assert {(r[1], r[2], r[3]) for r in pages} == {
        ("Missing values (any column)", 1, "O6"),
        ("Invalid payment_status spelling/case", 1, "O5"),
        ("Quantity <= 0", 1, "O7"),
        ("Discount outlier (> 16% IQR fence)", 1, "O4"),
        ("customer_id not in Customers", 1, "O5"),
        ("product_id not in Products", 1, "O6"),
        ("Order date outside 2025", 1, "O8"),
    }
    affected = quality.affected_rows(sales.raw(), sales.customers, sales.products, YEAR)
    assert ids(affected) == ["O4", "O5", "O6", "O7", "O8"]
    assert len(affected.columns) == 15


def test_sql_quality_reports(sales):
    assert rows(cleaning.row_counts(sales.raw(), sales.products)) == [
        ("orders_raw", 8),
        ("orders", 6),
    ]
    assert sorted(rows(quality.orphans(sales.raw(), sales.customers, sales.products))) == [
        ("O5", "C999", "P2", "Missing customer", None),
        ("O6", "C1", "P999", None, "Missing product"),
    ]
    invalid = quality.invalid_values(sales.raw()).orderBy("order_id")
    assert rows(invalid, "order_id", "issue") == [
        ("O4", "Discount outlier"),
        ("O6", "Missing sales values"),
        ("O7", "Invalid quantity"),
    ]
    assert rows(quality.status_spelling(sales.raw())) == [
        ("Paid", 4),
        ("Overdue", 2),
        ("Pending", 1),
        ("pending", 1),
    ]
    assert rows(quality.duplicate_ids(sales.raw())) == []


def test_cleaning(sales):
    assert [r[1] for r in rows(cleaning.cleaning_log(sales.raw(), sales.products))] == [0, 1, 1]
    assert rows(cleaning.cleaning_summary(sales.raw(), sales.products)) == [(8, 6, 2)]
    clean = {r.order_id: r for r in sales.clean().collect()}
    assert sorted(clean) == ["O1", "O2", "O3", "O4", "O5", "O8"]
    assert clean["O1"].salesperson == "Amit"
    five = clean["O5"]
    assert (five.payment_status, five.customer_name, five.city, five.customer_type) == (
        "Pending", "Unknown", "Unknown", "Unknown",
    )
    assert five.unknown_customer
    four = clean["O4"]
    assert (four.city, four.unknown_customer, four.discount_outlier) == ("Unknown", False, True)
    assert (four.year_month, four.order_month_num, four.order_month, four.quarter) == (
        "2025-03", 3, "Mar", "Q1",
    )
    margins = {i: r.profit_margin_pct for i, r in clean.items()}
    assert margins == {"O1": 30.0, "O2": 21.05, "O3": 0.0, "O4": -7.69, "O5": 25.0, "O8": 8.16}
    assert len(sales.clean().columns) == 29
    assert [i for i, r in clean.items() if r.is_loss] == ["O4"]


def test_validation(sales):
    clean = sales.clean()
    assert [(r.passed, r.violations) for r in validation.validate(clean, sales.products).collect()] == [
        (True, 0)
    ] * 5
    validation.require_valid(clean, sales.products)
    with pytest.raises(ValueError, match="payment_status"):
        validation.require_valid(clean.filter("payment_status <> 'Overdue'"), sales.products)


def test_headline(sales):
    assert rows(sql_reports.headline(sales)) == [(6, 42, 3850, 291, 3559, 584, 16.41, 593.17)]
    full = [r[1] for r in rows(frame_reports.kpi_full(sales))]
    close(full, [6.0, 42.0, 3850.0, 291.0, 3559.0, 2975.0, 584.0, 16.41, 593.17, 4.0, 1.0])


def test_months(sales):
    assert rows(sql_reports.monthly_trend(sales)) == [
        ("2025-01", 2, 1950, 500, None),
        ("2025-03", 2, 1160, -20, -40.51),
        ("2025-04", 1, 400, 100, -65.52),
        ("2026-01", 1, 49, 4, -87.75),
    ]
    found = rows(frame_reports.monthly(sales), "order_month", "orders", "net_sales", "mom_growth_pct")
    close(
        found,
        [("Jan", 3, 1999.0, None), ("Mar", 2, 1160.0, -41.97), ("Apr", 1, 400.0, -65.52)],
    )
    assert rows(sql_reports.quarterly(sales), "quarter", "orders", "net_sales") == [
        ("Q1", 5, 3159),
        ("Q2", 1, 400),
    ]
    assert rows(frame_reports.quarters(sales), "quarter", "orders") == [("Q1", 5), ("Q2", 1)]


def test_products(sales):
    assert rows(sql_reports.category_performance(sales)) == [
        ("Plumbing", 2, 7, 1350, 300, 22.22, 37.93),
        ("Hardware", 2, 14, 1260, 280, 22.22, 35.4),
        ("Safety", 2, 21, 949, 4, 0.42, 26.66),
    ]
    assert rows(sql_reports.top_products(sales, 2), "product_id") == [("P2",), ("P1",)]
    assert rows(sql_reports.bottom_margin_products(sales, 1), "product_id", "margin_pct") == [
        ("P3", 0.42)
    ]
    assert rows(frame_reports.bottom_margin_products(sales, 2), "product_id") == [("P3",), ("P1",)]
    best = sql_reports.best_product_per_category(sales)
    assert rows(best, "product_name") == [("Pipe",), ("Hammer",), ("Gloves",)]


def test_customers(sales):
    assert rows(sql_reports.city_sales(sales), "city", "customers", "orders", "net_sales") == [
        ("Pune", 1, 2, 1900),
        ("Agra", 1, 2, 999),
        ("Unknown", 2, 2, 660),
    ]
    ranked = rows(frame_reports.customers(sales), "customer_id", "net_sales", "cum_share_pct")
    close(
        ranked,
        [
            ("C1", 1900.0, 53.39),
            ("C2", 999.0, 81.46),
            ("C999", 400.0, 92.69),
            ("C3", 260.0, 100.0),
        ],
    )
    close(rows(frame_reports.pareto(sales)), [(1, 53.39)])
    assert rows(sql_reports.top_customers(sales), "customer_id", "city") == [
        ("C1", "Pune"),
        ("C2", "Agra"),
        ("C3", None),
    ]
    assert rows(sql_reports.customer_type_sales(sales), "customer_type", "avg_order_value") == [
        ("Retailer", 950.0),
        ("Wholesaler", 499.5),
        ("Unknown", 400.0),
        ("Contractor", 260.0),
    ]


def test_people_and_payments(sales):
    ranks = sql_reports.salesperson_rank(sales)
    assert rows(ranks, "salesperson", "orders", "net_sales", "profit", "sales_rank") == [
        ("Neha", 3, 1899, 204, 1),
        ("Amit", 3, 1660, 380, 2),
    ]
    assert rows(sql_reports.payment_status_summary(sales), "payment_status", "orders", "net_sales") == [
        ("Pending", 2, 1350),
        ("Paid", 2, 1260),
        ("Overdue", 2, 949),
    ]
    assert rows(frame_reports.payment_status(sales), "payment_status") == [
        ("Paid",),
        ("Pending",),
        ("Overdue",),
    ]
    assert rows(sql_reports.top_overdue_customers(sales), "customer_id", "overdue_amount") == [
        ("C1", 900.0),
        ("C2", 49.0),
    ]


def test_discounts(sales):
    assert rows(sql_reports.discount_band_margin(sales)) == [
        ("1) 0%", 2, 1400, 28.57, 0),
        ("2) 1-5%", 2, 999, 20.42, 0),
        ("3) 6-10%", 1, 900, 0.0, 0),
        ("4) >10%", 1, 260, -7.69, 1),
    ]
    assert rows(frame_reports.discount_bands(sales), "discount_band", "orders", "loss_orders") == [
        ("0%", 2, 0),
        ("1-5%", 2, 0),
        ("6-10%", 1, 0),
        (">10%", 1, 1),
    ]
    assert rows(frame_reports.discount_margin_correlation(sales)) == [(-0.807,)]
    close(rows(frame_reports.loss_summary(sales)), [(1, 20.0, 35.0, 8.67)])
    assert rows(frame_reports.loss_by_category(sales)) == [("Hardware", 1, -20.0)]
    assert rows(sql_reports.loss_orders(sales), "order_id", "profit") == [("O4", -20.0)]


def test_findings(sales):
    close(rows(findings.receivables(sales)), [(2299.0, 64.6, 1350.0, 949.0, 2)])
    close(rows(findings.discount_share(sales)), [(3850.0, 291.0, 7.56)])
    close(
        rows(findings.best_worst_month(sales)),
        [("2025-01", 1950.0, "2026-01", 49.0, -87.75)],
    )
    assert rows(findings.hidden_problem_products(sales, top=3), "product_id", "sales_rank") == [
        ("P3", 3)
    ]
    assert rows(findings.loss_vs_threshold(sales)) == [(1, 1, 100.0, 35.0)]
    assert rows(findings.largest_loss(sales)) == [("O4", 35.0, 260.0, -20.0)]
    close(rows(findings.overdue_concentration(sales, top=1)), [(900.0, 949.0, 94.84)])
    assert rows(findings.scope_counts(sales)) == [(6, 4, 3, 2, 3, 2)]
    assert rows(findings.below_average_categories(sales), "category") == [("Safety",)]
    assert rows(findings.slow_months(sales), "year_month") == [("2025-04",), ("2026-01",)]
    leaders = {r.finding: (r.name, r.value) for r in findings.leaders(sales).collect()}
    assert leaders["Top salesperson by sales"] == ("Neha", 1899.0)
    assert leaders["Most overdue orders"] == ("Neha", 2.0)
    assert leaders["Lowest margin (%)"][0] == "Neha"
    assert leaders["Top city by sales"] == ("Pune", 1900.0)


def test_dashboard(sales):
    cube = dashboard.cube(sales)
    everything = cube.filter("all_salespeople AND all_categories").drop(
        "salesperson", "category", "all_salespeople", "all_categories"
    )
    more = ("total_cost", "active_customers", "loss_orders")
    assert rows(everything.drop(*more)) == rows(sql_reports.headline(sales))
    assert rows(everything, *more) == [(2975.0, 4, 1)]
    one = cube.filter("salesperson = 'Neha' AND category = 'Safety'")
    assert rows(one, "total_orders", "net_sales") == [(2, 949.0)]
    picked = dashboard.Selection(sales, salesperson="Neha", category="Safety")
    assert rows(sql_reports.headline(picked), "total_orders", "net_sales") == [(2, 949.0)]
    assert rows(frame_reports.monthly(picked), "order_month") == [("Jan",), ("Mar",)]
    assert ids(picked.clean()) == ["O3", "O8"]
    everything = dashboard.Selection(sales)
    assert rows(sql_reports.headline(everything)) == rows(sql_reports.headline(sales))


def test_profiling(sales):
    raw = sales.raw()
    assert rows(profiling.preview(raw, raw.select("order_id"), "order_id", 2), "order_id") == [("O1",), ("O2",)]
    nulls = {r["column"]: r.non_null for r in profiling.profile_nulls(raw).collect()}
    assert (nulls["order_id"], nulls["profit"]) == (8, 7)
    stats = {r["column"]: r for r in profiling.describe_numeric(raw).collect()}
    discount = stats["discount_pct"]
    assert (discount["min"], discount.q1, discount.q3, discount["max"]) == (0.0, 0.0, 6.25, 35.0)
    assert stats["order_date"].std is None
    assert rows(profiling.date_range(raw)) == [(date(2025, 1, 10), date(2026, 1, 1))]
    assert rows(profiling.value_counts(sales.customers, "city")) == [("Agra", 1), ("Pune", 1)]


def test_every_report_runs(sales):
    """All of the catalog on the fixture, whose masters are complete but tiny."""
    for name in catalog.REPORTS:
        catalog.run(name, sales).schema  # noqa: B018 - analysis only
