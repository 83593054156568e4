import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens.schema import CUSTOMERS, ORDERS_RAW, PRODUCTS  # noqa: E402
from orderlens.session import local_session  # noqa: E402
from orderlens.warehouse import from_tables  # noqa: E402

CUSTOMER_ROWS = [
    ("C1", "Asha Traders", "Pune", "Retailer", None),
    ("C2", "Bell Works", "Agra", "Wholesaler", None),
    ("C3", "Crest", None, "Contractor", None),
]
PRODUCT_ROWS = [
    ("P1", "Hammer", "Hardware"),
    ("P2", "Pipe", "Plumbing"),
    ("P3", "Gloves", "Safety"),
]
# id, day, customer, product, quantity, discount, status, salesperson,
# unit cost, price, gross, discount amount, net, cost, profit
ORDER_ROWS = [
    ("O1", date(2025, 1, 10), "C1", "P1", 10, 0, "Paid", " amit ", 70, 100, 1000, 0, 1000, 700, 300),
    ("O2", date(2025, 1, 20), "C2", "P2", 5, 5, "Pending", "Neha", 150, 200, 1000, 50, 950, 750, 200),
    ("O3", date(2025, 3, 5), "C1", "P3", 20, 10, "Overdue", "Neha", 45, 50, 1000, 100, 900, 900, 0),
    ("O4", date(2025, 3, 6), "C3", "P1", 4, 35, "Paid", "Amit", 70, 100, 400, 140, 260, 280, -20),
    ("O5", date(2025, 4, 1), "C999", "P2", 2, 0, "pending", "Amit", 150, 200, 400, 0, 400, 300, 100),
    ("O6", date(2025, 4, 2), "C1", "P999", 3, 5, "Paid", "Neha", *[None] * 7),
    ("O7", date(2025, 5, 1), "C2", "P1", -3, 0, "Paid", "Amit", 70, 100, -300, 0, -300, -210, -90),
    ("O8", date(2026, 1, 1), "C2", "P3", 1, 2, "Overdue", "Neha", 45, 50, 50, 1, 49, 45, 4),
]


def as_decimals(row):
    return tuple(
        Decimal(str(v)) if v is not None and (i == 5 or i >= 8) else v for i, v in enumerate(row)
    )


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(
        4,
        4,
        **{
            "spark.checkpoint.dir": str(folder / "shared"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_orders(spark):
    def make(rows):
        return spark.createDataFrame([as_decimals(r) for r in rows], ORDERS_RAW)

    return make


@pytest.fixture(scope="session")
def masters(spark):
    return (
        spark.createDataFrame(CUSTOMER_ROWS, CUSTOMERS),
        spark.createDataFrame(PRODUCT_ROWS, PRODUCTS),
    )


@pytest.fixture(scope="session")
def make_sales(make_orders, masters):
    return lambda rows: from_tables(make_orders(rows), *masters)


@pytest.fixture(scope="session")
def sales(make_sales):
    return make_sales(ORDER_ROWS)


@pytest.fixture(scope="session")
def order():
    """An order row with some columns changed by position name."""
    names = ORDERS_RAW.names

    def make(order_id, **changes):
        row = dict(zip(names, ORDER_ROWS[0]), order_id=order_id, salesperson="Amit")
        row.update(changes)
        return tuple(row[n] for n in names)

    return make
