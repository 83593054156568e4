"""Reading, writing and the prepared tables."""

import math
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from orderlens import catalog, warehouse
from orderlens.operators import quality
from orderlens.schema import CLEAN_COLUMNS, ORDER_COLUMNS, ORDERS_RAW
from orderlens.session import staging_dir
from orderlens.sources import tables, versions
from orderlens.warehouse import StoredSales, build, from_star, from_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_inputs_round_trip(spark, sales, tmp_path, fmt):
    given = {"orders": sales.raw(), "customers": sales.customers, "products": sales.products}
    tables.write_tables(given, str(tmp_path), fmt)
    found = tables.read_inputs(spark, str(tmp_path), fmt)
    assert found["orders"].schema == ORDERS_RAW
    for name, df in given.items():
        assert sorted(found[name].collect(), key=str) == sorted(df.collect(), key=str)


def test_not_a_number_becomes_missing(spark, sales, tmp_path):
    doubles = sales.raw().withColumns({c: sales.raw()[c].cast("double") for c in ORDER_COLUMNS[8:]})
    rows = [tuple(math.nan if v is None else v for v in r) for r in doubles.collect()]
    spark.createDataFrame(rows, doubles.schema).write.parquet(f"{tmp_path}/orders")
    found = tables.read_table(spark, str(tmp_path), "orders")
    assert sorted(found.collect(), key=str) == sorted(sales.raw().collect(), key=str)


def test_clean_csv(spark, sales, tmp_path):
    path = f"{tmp_path}/clean"
    tables.write_clean_csv(sales.clean(), path)
    found = spark.read.option("header", True).csv(path)
    assert tuple(found.columns) == CLEAN_COLUMNS
    flags = {r.order_id: (r.is_loss, r.unknown_customer) for r in found.collect()}
    assert flags["O4"] == ("True", "False") and flags["O5"] == ("False", "True")


def test_relational_export(spark, sales):
    args = (sales.raw(), sales.clean(), sales.customers, sales.products)
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    for _ in range(2):  # a second run replaces the tables
        tables.save_relational(*args, database="shop")
    assert spark.table("shop.orders_raw").count() == 8
    assert tuple(spark.table("shop.orders").columns) == ORDER_COLUMNS
    tables.register_views(*args)
    total = spark.sql(
        "SELECT sum(o.net_sales) FROM orders o JOIN products p USING (product_id)"
        " WHERE p.category = 'Safety'"
    )
    assert total.first()[0] == Decimal("949.00")


def test_master_keys(spark, sales):
    tables.require_unique_masters(sales.customers, sales.products)
    twice = sales.products.unionByName(sales.products.limit(1))
    with pytest.raises(ValueError, match="products"):
        tables.require_unique_masters(sales.customers, twice)


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    """The smallest supplied tables, planned live and written once."""
    live = from_star(spark, SF_DIR)
    return live, build(live, str(tmp_path_factory.mktemp("prepared")), catalog.EXPECTED_YEARS)


SUMMED = (
    "kpi_headline", "monthly_trend", "quarterly", "category_perf", "top_products", "bottom_margin_products",
    "best_product_per_category", "city_sales", "customer_type_sales", "top_customers", "salesperson_rank",
    "payment_status_summary", "top_overdue_customers", "discount_band_margin", "kpi_full", "monthly_by_month_num",
    "category_perf_df", "top10_products", "city_perf", "customer_perf", "pareto_top20", "salesperson_perf",
    "payment_status_domain", "overdue_customers_df", "discount_band_df", "quarterly_df", "dashboard_cube",
    "kpi_filtered", "best_worst_month", "below_avg_categories", "slow_months", "receivables",
    "discount_share_of_gross", "overdue_concentration", "chart_monthly_trend_filtered",
)
COMPARED = (
    "kpi_headline", "monthly_trend", "category_perf", "salesperson_rank", "discount_band_margin", "kpi_full",
    "dashboard_cube", "kpi_filtered", "city_sales", "top_products", "top_overdue_customers", "scope_counts",
)


@pytest.mark.parametrize("name", COMPARED)
def test_prepared_tables_give_the_same_reports(prepared, name):
    live, stored = prepared
    one = catalog.run(name, live).collect()
    other = catalog.run(name, stored).collect()
    assert one and sorted(one, key=str) == sorted(other, key=str)


class SumsOnly(StoredSales):
    """Written tables without their lines."""

    def marked(self):
        raise AssertionError("the cleaned lines are read")

    raw = marked


def test_summed_reports_read_only_sums(prepared):
    """The plans of these reports can be made without the lines."""
    stored = prepared[1]
    bare = SumsOnly(stored.spark, "", stored.path)
    for name in SUMMED:
        catalog.run(name, bare)
    with pytest.raises(AssertionError):
        catalog.run("loss_orders", bare)


def test_prepared_logs(spark, prepared):
    live, stored = prepared
    assert tuple(stored.clean().columns) == CLEAN_COLUMNS
    assert {r.check_no for r in stored.log("quality_log").collect()} == set(range(1, 13))
    # Counted while writing, equal to the counts of the reports.
    assert stored.log("cleaning_log").collect() == catalog.run("cleaning_log", live).collect()
    verdicts = {r.rule: (r.passed, r.violations) for r in stored.log("validation").collect()}
    names = ("validate_money", "validate_qty", "validate_status", "validate_unique", "validate_product_fk")
    assert verdicts == {r.rule: (r.passed, r.violations) for n in names for r in catalog.run(n, live).collect()}
    removed = stored.marked().filter("removed_for <> 'none'")
    assert removed.count() == sum(r.rows_removed for r in stored.log("cleaning_log").collect()) > 0


def test_a_month_is_a_folder(prepared):
    _, stored = prepared
    plan = stored.facts("net_sales", "year_month").filter("year_month = '1996-03'")._jdf.queryExecution().toString()
    line = next(text for text in plan.splitlines() if "PartitionFilters" in text)
    assert "year_month" in line.split("PartitionFilters")[1].split("PushedFilters")[0]
    months = stored.facts("year_month").distinct().count()
    assert stored.facts("net_sales", "year_month").filter("year_month = '1996-03'").count() > 0 and months > 70


def test_invalid_clean_table_is_not_published(spark, sales, make_orders, masters, tmp_path, order):
    with pytest.raises(ValueError, match="unique"):
        build(from_tables(make_orders([order("A"), order("A")]), *masters), str(tmp_path), (2025, 2025))
    with pytest.raises(FileNotFoundError):
        StoredSales(spark, str(tmp_path))
    good = [order("A"), order("B", payment_status="Pending"), order("C", payment_status="Overdue")]
    for more in ([], [order("D")]):
        build(from_tables(make_orders(good + more), *masters), str(tmp_path), (2025, 2025))
    for bad, text in (
        ([order("D", net_sales=None)], "money"),
        ([order("D", quantity=None)], "quantity"),
        ([order("D", payment_status="Lost")], "Paid, Pending"),
    ):
        with pytest.raises(ValueError, match=text):
            build(from_tables(make_orders(good + bad), *masters), str(tmp_path), (2025, 2025))
    assert StoredSales(spark, str(tmp_path)).clean().count() == 4
    assert versions.published(spark, str(tmp_path)).count() == 2


def test_a_build_that_breaks_leaves_the_old_tables(spark, make_orders, masters, tmp_path, order, monkeypatch):
    good = [order("A"), order("B", payment_status="Pending"), order("C", payment_status="Overdue")]
    old = build(from_tables(make_orders(good), *masters), str(tmp_path), (2025, 2025))

    def broken(stored):
        raise OSError("disk full")

    monkeypatch.setattr(warehouse, "write_clean", broken)
    with pytest.raises(OSError):
        build(from_tables(make_orders(good + [order("D")]), *masters), str(tmp_path), (2025, 2025))
    now = StoredSales(spark, str(tmp_path))
    assert now.path == old.path and now.raw().count() == now.clean().count() == 3
    monkeypatch.undo()
    new = build(from_tables(make_orders(good + [order("D")]), *masters), str(tmp_path), (2025, 2025))
    assert new.clean().count() == 4 and old.clean().count() == 3  # a reader keeps its version


def test_relational_export_that_breaks_leaves_the_old_tables(spark, sales, make_orders, masters, order):
    spark.sql("CREATE DATABASE IF NOT EXISTS fragile")
    args = (sales.raw(), sales.clean(), sales.customers, sales.products)
    tables.save_relational(*args, database="fragile")
    failing = sales.customers.withColumn("city", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        tables.save_relational(make_orders([order("A")]), sales.clean().limit(1), failing, sales.products, database="fragile")
    assert [spark.table(f"fragile.{t}").count() for t in tables.RELATIONAL] == [8, 6, 3, 3]
    assert tables.unread_versions(spark, "fragile") == []
    tables.save_relational(*args, database="fragile")
    assert len(tables.unread_versions(spark, "fragile")) == 4


ORDER_CSV = [
    ",".join(ORDER_COLUMNS),
    "O1,2025-01-10,C1,P1,10,0.00,Paid,Amit,70.0000,100.0000,1000.0000,0.0000,1000.0000,700.0000,300.0000",
    "O2,2025-13-40,C1,P1,10,0.00,Paid,Amit,70,100,1000,0,1000,700,300",
    "O3,2025-01-10,C1,P1,ten,x,Paid,Amit,70,100,1000,0,1000,700,300",
    "O4,2025-01-10,C1",
    "O5,2025-01-10,C1,P1,10,0,Paid,Amit,70,100,1000,0,1000,700,300,one too many",
    "O6,,C1,P1,,NaN,Paid, Amit ,nan,100,1000,0,1000,700,300",
]


def test_unreadable_rows_are_kept_apart(spark, sales, tmp_path):
    given = {"customers": sales.customers, "products": sales.products}
    tables.write_tables(given, str(tmp_path), "csv")
    (tmp_path / "orders").mkdir()
    (tmp_path / "orders" / "part.csv").write_text("\n".join(ORDER_CSV) + "\n")
    found = tables.read_inputs(spark, str(tmp_path), "csv")
    assert sorted(r.order_id for r in found["orders"].collect()) == ["O1", "O6"]
    # Whatever columns a query reads, the same rows are good.
    assert [found["orders"].select(c).count() for c in ("order_id", "quantity", "profit")] == [2] * 3
    odd = found["orders"].filter("order_id = 'O6'").first()
    assert (odd.order_date, odd.quantity, odd.discount_pct, odd.unit_cost, odd.salesperson) == (None, None, None, None, " Amit ")
    rejects = {r.record.split(",")[0]: (r.table, r.reason) for r in found["rejects"].collect()}
    assert rejects == {
        "O2": ("orders", "order_date"),
        "O3": ("orders", "quantity, discount_pct"),
        "O4": ("orders", "number of fields"),
        "O5": ("orders", "number of fields"),
    }
    assert found["customers"].count() == 3


def test_rejects_of_typed_files_and_in_the_build(spark, sales, tmp_path, make_orders, order):
    texts = make_orders([order(i, payment_status=s) for i, s in (("A", "Paid"), ("B", "Pending"), ("C", "Overdue"), ("D", "Paid"))])
    texts = texts.select([F.col(c).cast("string") for c in texts.columns])
    bad = F.when(F.col("order_id") == "D", "many").otherwise(F.col("quantity"))
    texts.withColumn("quantity", bad).write.parquet(f"{tmp_path}/in/orders")
    tables.write_tables({"customers": sales.customers, "products": sales.products}, f"{tmp_path}/in")
    found = tables.read_inputs(spark, f"{tmp_path}/in")
    stored = build(from_tables(*(found[k] for k in ("orders", "customers", "products", "rejects"))), f"{tmp_path}/out", (2025, 2025))
    assert sorted(r.order_id for r in stored.clean().collect()) == ["A", "B", "C"]
    (row,) = stored.log("rejects").collect()
    assert (row.table, row.reason) == ("orders", "quantity") and '"many"' in row.record


def test_staging_folder_is_the_configured_one(spark):
    assert staging_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize(
    "column, tables_read",
    [
        ("order_id", {"lineitem", "part"}),
        ("net_sales", {"lineitem", "part"}),
        ("payment_status", {"lineitem", "part", "orders"}),
        ("salesperson", {"lineitem", "part", "supplier"}),
    ],
)
def test_only_needed_tables_are_read(spark, column, tables_read):
    """``part`` is always read: it is the product master."""
    files = from_star(spark, SF_DIR).facts(column).inputFiles()
    assert {f.rsplit("/", 1)[1].removesuffix(".parquet") for f in files} == tables_read


def test_fence_of_nothing(sales):
    assert quality.iqr_fence(sales.raw().limit(0)).first().fence is None
