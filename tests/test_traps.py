"""Missing values, ties, odd spellings and repeated ids: one case per rule."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlens import session
from orderlens.functions import columns as expressions
from orderlens.operators import cleaning, measures, ordering, profiling, quality, validation
from orderlens.plans import dashboard, findings, frame_reports, sql_reports
from orderlens.warehouse import from_star
from tests.conftest import ORDER_ROWS


def values(df, column):
    return [r[column] for r in df.collect()]


def test_missing_quantity_is_kept(make_sales, order):
    sales = make_sales([order("A", quantity=None), order("B", quantity=0), order("C")])
    assert sorted(values(sales.clean(), "order_id")) == ["A", "C"]


def test_missing_status_and_date_are_flagged(make_sales, order):
    raw = make_sales([order("A", payment_status=None), order("B", order_date=None)]).raw()
    assert values(quality.ids_where(raw, quality.bad_status()), "order_id") == ["A"]
    assert values(quality.ids_where(raw, quality.outside_years(2025, 2025)), "order_id") == ["B"]


def test_missing_amounts_break_no_identity(make_sales, order):
    raw = make_sales([order("A", gross_sales=None), order("B", gross_sales=990)]).raw()
    assert values(quality.ids_where(raw, quality.gross_differs()), "order_id") == ["B"]


def test_tolerance_is_exclusive(make_sales, order):
    raw = make_sales([order("A", profit="300.01"), order("B", profit="300.0101")]).raw()
    assert values(quality.ids_where(raw, quality.profit_differs()), "order_id") == ["B"]


def test_missing_keys_in_groups(make_sales, order):
    """SQL reports keep the group of a missing key, frame reports drop it."""
    sales = make_sales(
        [order("A"), order("B", salesperson=None), order("C", order_date=None, customer_id=None)]
    )
    assert None in values(sql_reports.salesperson_rank(sales), "salesperson")
    assert values(frame_reports.salespeople(sales), "salesperson") == ["Amit"]
    assert values(sql_reports.monthly_trend(sales), "year_month") == [None, "2025-01"]
    assert values(frame_reports.monthly(sales), "order_month") == ["Jan"]
    assert values(sql_reports.quarterly(sales), "quarter") == [None, "Q1"]
    assert values(frame_reports.customers(sales), "customer_id") == ["C1"]
    cities = {r.city: (r.customers, r.orders) for r in sql_reports.city_sales(sales).collect()}
    assert cities == {"Pune": (1, 2), "Unknown": (0, 1)}


def test_orders_without_id(make_sales, order):
    """SQL reports count rows, frame reports present ids."""
    sales = make_sales([order("A"), order(None)])
    assert values(sql_reports.quarterly(sales), "orders") == [2]
    assert values(frame_reports.quarters(sales), "orders") == [1]


def test_bands(make_sales, order):
    percents = [-1, "-0.5", 0, "0.5", 5, "5.5", 10, "10.5", 100, 101, None]
    sales = make_sales([order(f"A{i:02}", discount_pct=p) for i, p in enumerate(percents)])
    facts = sales.facts("order_id", "discount_pct", "discount_band").orderBy("order_id")
    assert values(facts, "discount_band") == [
        None, "0%", "0%", "1-5%", "1-5%", "6-10%", "6-10%", ">10%", ">10%", None, None,
    ]
    case = facts.select(expressions.band_by_case(F.col("discount_pct")).alias("band"))
    assert values(case, "band") == [
        "2) 1-5%", "2) 1-5%", "1) 0%", "2) 1-5%", "2) 1-5%",
        "3) 6-10%", "3) 6-10%", "4) >10%", "4) >10%", "4) >10%", "4) >10%",
    ]


def test_outlier_flag_is_not_the_fence(make_sales, order):
    raw = [order(f"A{i}", discount_pct=p) for i, p in enumerate([0, 0, 0, 0, 15, None])]
    sales = make_sales(raw)
    assert values(quality.iqr_outliers(sales.raw()), "order_id") == ["A4"]
    assert values(sales.facts("order_id", "discount_pct", "discount_outlier"), "discount_outlier") == [
        False
    ] * 6


def test_loss_and_margin_come_before_rounding(make_sales, order):
    sales = make_sales([order("A", profit="-0.004", net_sales=100), order("B", net_sales=0)])
    clean = {r.order_id: r for r in sales.clean().collect()}
    assert clean["A"].is_loss and clean["A"].profit == 0
    assert values(sql_reports.loss_orders(sales), "order_id") == []
    assert clean["B"].profit_margin_pct is None


def test_money_rounds_halves_to_even(make_sales, order):
    cents = {"A": "0.125", "B": "0.135", "C": "-0.125", "D": "0.1251"}
    sales = make_sales([order(i, cost=v) for i, v in cents.items()])
    found = {r.order_id: str(r.cost) for r in sales.facts("order_id", "cost").collect()}
    assert found == {"A": "0.12", "B": "0.14", "C": "-0.12", "D": "0.13"}


def test_ratios_round_half_up_exactly(spark):
    df = spark.sql("SELECT CAST(1653098 AS DECIMAL(38,2)) AS total, 80L AS n, 0L AS none")
    row = df.select(
        expressions.mean2("total", "n").alias("mean"), expressions.mean2("total", "none").alias("no")
    ).first()
    assert (row["mean"], row["no"]) == (20663.73, None)


NAMES = [
    "  amit ", " o'neil-roy", "PENDING", "paid", "Supplier#000000001", "x1y zed", "Mary  Ann",
    "A-b", "A-B", "McDonald", " amit ", "Amit\n", "émile zola", "ab中cd", "", "A1b", "1a",
]


@pytest.mark.parametrize("name", NAMES)
def test_title_case(spark, name):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(expressions.strip_title(F.col("name"))).first()[0] == name.strip().title()


def test_unknown_text_and_flag(make_sales, order):
    """A known customer without a city reads Unknown too, but is not flagged."""
    sales = make_sales([order("A", customer_id="C3"), order("B", customer_id=None)])
    found = {r.order_id: (r.city, r.unknown_customer) for r in sales.clean().collect()}
    assert found == {"A": ("Unknown", False), "B": ("Unknown", True)}


def test_two_faults_are_logged_once(make_sales, order):
    sales = make_sales([order("A", product_id="P9", quantity=-1), order("B", product_id=None)])
    log = cleaning.cleaning_log(sales.raw(), sales.products)
    assert values(log, "rows_removed") == [0, 2, 0]


def test_repeated_ids_and_rows(make_sales, order):
    rows = [order("A"), order("A"), order("A", quantity=1), order("B"), order(None), order(None)]
    raw = make_sales(rows).raw()
    assert sorted(values(quality.repeated_ids(raw), "order_id"), key=str) == ["A", "A", None]
    assert sorted(values(quality.repeated_rows(raw), "order_id"), key=str) == ["A", None]
    counts = quality.violation_counts(raw, *_masters(make_sales), (2025, 2025))
    found = {(r.check_no, r.order_id): r.copies for r in counts.collect()}
    assert (found[2, "A"], found[3, "A"], found[2, None], found[3, None]) == (2, 1, 1, 1)
    assert found[1, None] == 2
    clean = make_sales(rows).clean()
    assert [r.violations for r in validation.unique_ids(clean).collect()] == [2]


def test_repeats_by_codes_that_collide(make_sales, order):
    """Codes only choose candidates: with one code for all ids the results are the same."""
    rows = [order("A"), order("A"), order("A", quantity=1), order("B"), order(None), order(None), order("C", customer_id=None)]
    raw = make_sales(rows).raw()

    def same(*_):
        return F.lit(1).cast("bigint")

    assert sorted(values(quality.repeated_ids(raw, code=same), "order_id"), key=str) == ["A", "A", None]
    assert sorted(values(quality.repeated_rows(raw, code=same), "order_id"), key=str) == ["A", None]
    assert sorted(quality.duplicate_ids(raw, code=same).collect(), key=str) == sorted(quality.duplicate_ids(raw).collect(), key=str)


def test_repeats_beyond_what_is_sent_to_tasks(make_sales, order, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_SENT", 0)
    sales = make_sales([order("A"), order("A"), order("B", quantity=-1), order("C"), order(None), order(None)])
    raw = sales.raw()
    assert sorted(values(quality.repeated_ids(raw), "order_id"), key=str) == ["A", None]
    affected = quality.affected_rows(raw, sales.customers, sales.products, (2025, 2025))
    assert sorted(values(affected, "order_id"), key=str) == ["A", "A", "B", None, None]


def test_active_customers_through_the_cube(make_sales, order):
    """A customer in several groups counts once above them; a missing id counts nowhere."""
    rows = [
        order("A"), order("B", product_id="P2"), order("C", salesperson="Neha"), order("D", customer_id="C2", salesperson="Neha"),
        order("E", customer_id="C999"), order("F", customer_id=None), order("G", customer_id=None, salesperson="Zoe", profit=-5),
    ]
    found = {
        (r.salesperson, r.category, r.all_salespeople, r.all_categories): (r.active_customers, r.total_orders, r.loss_orders)
        for r in dashboard.cube(make_sales(rows)).collect()
    }
    assert found[None, None, True, True] == (3, 7, 1)
    assert found["Amit", None, False, True] == (2, 4, 0)
    assert found[None, "Hardware", True, False] == (3, 6, 1)
    assert found["Neha", "Hardware", False, False] == (2, 2, 0)
    assert found["Zoe", None, False, True] == (0, 1, 1)


def test_cube_total_equals_the_eleven_figures(sales):
    cube = dashboard.cube(sales).filter("all_salespeople AND all_categories").first()
    figures = {r.metric: r.value for r in frame_reports.kpi_full(sales).collect()}
    assert cube.active_customers == figures["Active customers"]
    assert cube.total_cost == pytest.approx(figures["Total cost (₹)"])
    assert cube.loss_orders == figures["Loss-making orders"]
    assert cube.net_sales == pytest.approx(figures["Net sales (₹)"])


def test_cube_expands_slices_only(sales):
    """The lines are neither expanded nor counted by distinct values."""
    plan = dashboard.cube(sales)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "count(distinct" not in plan and "bitmap_construct_agg" in plan
    below = plan[plan.index("Expand") :]
    assert "bitmap_construct_agg" in below


def test_many_blocks_of_customers(spark):
    """Bitmaps of several blocks: the same count as distinct values."""
    people = spark.range(70_000).select(
        F.concat(F.lit("C"), "id").alias("customer_id"), (F.col("id") % 3).alias("g"), F.lit(1).cast("bigint").alias("orders")
    )
    twice = people.unionByName(people.withColumn("g", F.lit(9).cast("bigint")).limit(10))
    sums = twice.groupBy("g").agg(F.sum("orders").alias("orders"))
    slices = measures.customer_slices(sums, twice.select("g", "customer_id"), ["g"], ["orders"])
    assert slices.select("block").distinct().count() == 4  # three of customers, one of sums
    one = measures.counted(slices, [], ["orders"]).first()
    assert (one.customers, one.orders) == (70_000, 70_010)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_customers_meet_the_orders_not_the_lines(spark, tmp_path):
    """The star's customers at order level: the same rows as at line level, also for lines without
    an order, orders without a customer, planted faults and customers that come twice."""
    tables = {
        "nation": ("n_nationkey int, n_name string", [(1, "Peru"), (2, None)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "A", 1, "X"), (2, None, 2, None), (3, "C", 9, "Y"), (3, "D", 1, "Y")]),
        "supplier": ("s_suppkey long, s_name string", [(1, " s one")]),
        "part": ("p_partkey long, p_name string, p_type string, p_retailprice double", [(1, "nut", "T", 10.0), (2, "nail", "U", 4.5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp", [(k, c, "F", None) for k, c in ((1, 1), (2, 2), (3, 3), (41, 1), (4, 77), (6, None))]),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double",
            [(k, n, 1 + k % 3, 1, 5.0, 0.05) for k in (1, 2, 3, 4, 41, 6, 8, 138) for n in (1, 2)] + [(None, 1, 1, None, None, None)],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sales = from_star(spark, str(tmp_path))
    apart = cleaning.build_clean(sales.raw(), sales.customers, sales.products)
    found = sales.clean()
    assert found.schema == apart.schema and found.count() > 10
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
    plan = optimized(found)
    assert plan.index("l_orderkey#") < plan.index("c_custkey#") and "c_custkey" in plan[plan.index("o_custkey") :]
    meets = [line for line in plan.splitlines() if "Join" in line and "customer_id" in line]
    assert len(meets) == 1 and plan.index("o_orderkey") < plan.index(meets[0])


def test_lines_meet_the_products_once(sales):
    """No lookup of lines just to drop those of unknown products."""
    assert "LeftSemi" not in optimized(sql_reports.loss_orders(sales))
    for report in (sql_reports.quarterly, frame_reports.quarters, sql_reports.payment_status_summary):
        plan = optimized(report(sales))
        assert "LeftSemi" not in plan
        assert plan.index("Join Inner") < plan.rindex("Aggregate [quarter" if "quarter" in plan else "Aggregate [payment_status")


def test_tasks_are_small_unless_the_session_says_otherwise(spark):
    was = spark.conf.get(session.TASK_INPUT)
    try:
        spark.conf.unset(session.TASK_INPUT)
        assert session.small_tasks(spark).conf.get(session.TASK_INPUT) == "16m"
        spark.conf.set(session.TASK_INPUT, "5m")
        assert session.small_tasks(spark).conf.get(session.TASK_INPUT) == "5m"
    finally:
        spark.conf.set(session.TASK_INPUT, was)


def test_cube_with_marks_equals_cube_with_bitmaps(make_sales, order, monkeypatch):
    """Many groups of few customers: no bitmap is made, and every selection counts the same."""
    rows = [
        order(f"{p}{k}{c}", product_id=p, salesperson=k, customer_id=c)
        for n, (p, k, c) in enumerate((p, k, c) for p in ("P1", "P2", "P3") for k in ("Amit", "Neha", None) for c in ("C1", "C2", "C999", None))
        if n % 5
    ]
    sales = make_sales([*rows, rows[0]])
    bitmaps = sorted(dashboard.cube(sales).collect(), key=str)
    monkeypatch.setattr(measures, "MOST_BITMAPS", 0)
    marked = dashboard.cube(sales)
    assert "bitmap" not in marked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(marked.collect(), key=str) == bitmaps and len(bitmaps) == 16
    # A selection from the slices, as written tables answer it.
    for where in ({}, {"salesperson": "Neha"}, {"category": "Safety"}, {"salesperson": "Amit", "category": "Plumbing"}, {"category": "None"}):
        one = measures.counted(measures.picked(sales.slices(("orders",)), where), [], ("orders",), where).first()
        lines = measures.picked(sales.clean(), where).select("customer_id")
        assert (one.customers, one.orders) == (lines.distinct().dropna().count(), lines.count())


def test_problem_products_are_those_under_fifteen_percent(make_sales, order):
    """A margin of 8 to 15 percent is a problem too, one of 15 is none."""
    rows = [order("A", profit=120), order("B", product_id="P2", profit=150), order("C", product_id="P3", profit=79)]
    found = {r.product_id: r.margin_pct for r in findings.hidden_problem_products(make_sales(rows)).collect()}
    assert found == {"P1": 12.0, "P3": 7.9}


def _masters(make_sales):
    sales = make_sales(ORDER_ROWS)
    return sales.customers, sales.products


def test_log_pages_are_whole(make_sales, order):
    """More ids than one page, one of them very often: nothing is lost or repeated."""
    rows = [order("HOT", quantity=-1) for _ in range(30)]
    rows += [order(f"X{i:02}", quantity=-1) for i in range(20)] + [order(None, quantity=-1)]
    sales = make_sales(rows)
    tables = (sales.raw(), sales.customers, sales.products, (2025, 2025))
    pages = [r for r in quality.id_pages(*tables, ids_per_page=7).collect() if r.check_name == "Quantity <= 0"]
    pages.sort(key=lambda r: r.page)
    listed = [i for r in pages for i in r.order_ids.split(", ")]
    assert listed == ["HOT"] * 30 + [f"X{i:02}" for i in range(20)] + ["nan"]
    assert [len(r.order_ids.split(", ")) for r in pages] == [7] * 7 + [2]
    log = quality.summary(*tables).collect()
    assert [r.check_no for r in log] == list(range(1, 13))
    assert [r.rows_affected for r in log if r.check_name == "Quantity <= 0"] == [51]


def test_rows_that_differ_by_the_place_of_a_missing_value(make_sales, order):
    """A hash that passes over missing values would take these for one row."""
    raw = make_sales([order("A", customer_id=None, product_id="X"), order("A", customer_id="X", product_id=None)]).raw()
    assert values(quality.repeated_rows(raw), "order_id") == []
    assert values(quality.repeated_ids(raw), "order_id") == ["A"]


def test_tied_best_products(spark, make_orders, order):
    from orderlens.warehouse import from_tables
    from tests.conftest import CUSTOMER_ROWS
    from orderlens.schema import CUSTOMERS, PRODUCTS

    products = [("P1", "Hammer", "Hardware"), ("P2", "Saw", "Hardware"), ("P3", "Nail", None)]
    sales = from_tables(
        make_orders([order("A"), order("B", product_id="P2"), order("C", product_id="P3")]),
        spark.createDataFrame(CUSTOMER_ROWS, CUSTOMERS),
        spark.createDataFrame(products, PRODUCTS),
    )
    best = sql_reports.best_product_per_category(sales)
    assert sorted(values(best, "product_name")) == ["Hammer", "Nail", "Saw"]
    shares = {r.category: r.sales_share_pct for r in sql_reports.category_performance(sales).collect()}
    assert shares == {"Hardware": 66.67, None: 33.33}
    frame = {r.category: r.sales_share_pct for r in frame_reports.category(sales).collect()}
    assert frame == {"Hardware": 100.0}


def test_absent_status(make_sales, order):
    """The domain report shows an empty row; validation fails, also for a foreign status."""
    sales = make_sales([order("A"), order("B", payment_status="Pending")])
    found = {r.payment_status: r.orders for r in frame_reports.payment_status(sales).collect()}
    assert found == {"Paid": 1, "Pending": 1, "Overdue": None}
    assert [r.violations for r in validation.status_set(sales.clean()).collect()] == [1]
    more = make_sales([order("C", payment_status="Lost"), order("D", payment_status="Overdue")])
    both = sales.clean().unionByName(more.clean())
    assert [r.violations for r in validation.status_set(both).collect()] == [1]


def test_growth_from_zero(make_sales, order):
    sales = make_sales(
        [order("A", net_sales=0), order("B", order_date=date(2025, 2, 1), net_sales=5)]
    )
    assert values(sql_reports.monthly_trend(sales), "mom_growth_pct") == [None, None]
    assert values(frame_reports.monthly(sales), "mom_growth_pct") == [None, None]


def test_empty_input(make_sales):
    sales = make_sales([])
    assert values(cleaning.cleaning_summary(sales.raw(), sales.products), "raw_rows") == [0]
    assert sql_reports.headline(sales).first().total_orders == 0
    assert frame_reports.pareto(sales).count() == 0
    assert frame_reports.payment_status(sales).count() == 3
    log = quality.summary(sales.raw(), sales.customers, sales.products, (2025, 2025))
    assert log.count() == 12


def test_group_totals_add_up(sales):
    net = sql_reports.headline(sales).first().net_sales
    for report in (
        sql_reports.monthly_trend,
        sql_reports.quarterly,
        sql_reports.category_performance,
        sql_reports.city_sales,
        sql_reports.customer_type_sales,
        sql_reports.salesperson_rank,
        sql_reports.payment_status_summary,
        sql_reports.discount_band_margin,
        frame_reports.city,
        frame_reports.customers,
    ):
        assert report(sales).agg(F.sum("net_sales")).first()[0] == pytest.approx(net)
    assert max(values(frame_reports.customers(sales), "cum_share_pct")) == pytest.approx(100)
    assert Decimal(str(net)) == Decimal("3559.0")


def test_preview_with_missing_and_tied_keys(make_sales, order):
    raw = make_sales([order(None), order("B"), order("A"), order("A", quantity=1), order("C")]).raw()
    keys = raw.select("order_id")
    assert values(profiling.preview(raw, keys, "order_id", 3), "order_id") == ["A", "A", "B"]
    assert values(profiling.preview(raw, keys, "order_id", 9), "order_id") == ["A", "A", "B", "C", None]
