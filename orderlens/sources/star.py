"""The order-line model as views over a TPC-H-like star schema.

Only the joins that the asked columns need are planned: the date, customer and status
come from ``orders``, the salesperson from ``supplier``, all money from ``part``. Every
join is a left join on a unique key, so leaving one out changes no row.

A few rows get a fault on purpose (``FAULTS``), so that each quality rule has work.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlens.operators.cleaning import CUSTOMER_COLUMNS, add_customer, unknown_customers
from orderlens.schema import MONEY_COLUMNS, ORDER_COLUMNS, ORDERS_RAW, PERCENT, RAW_MONEY

# fault -> (divisor, remainder) of the order key
FAULTS = {
    "customer": (97, 41),
    "product": (89, 56),
    "quantity": (83, 11),
    "discount": (79, 26),
    "status": (73, 7),
    "gross": (71, 9),
    "net": (67, 5),
    "profit": (61, 33),
    "cost": (59, 18),
}
# Orders whose lines come in twice: the same again, or with another discount.
SENT_AGAIN = {"same": (103, 12), "changed": (107, 20)}
SLIP = "0.02"  # how far a faulty amount is off
_schemas: dict[str, StructType] = {}
ORDER_LEVEL = {"order_date", "customer_id", "payment_status"}


def _hit(rule: tuple[int, int], key: str = "l_orderkey") -> Column:
    divisor, remainder = rule
    return F.col(key) % divisor == remainder


def _fault(name: str, key: str = "l_orderkey") -> Column:
    return _hit(FAULTS[name], key)


def _slip(name: str) -> Column:
    return F.when(_fault(name), F.lit(SLIP)).otherwise(F.lit("0")).cast("decimal(3,2)")


def _raw_money(value: Column) -> Column:
    return value.cast(RAW_MONEY)


def _order_id() -> Column:
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    keys.append(F.col("l_quantity").cast("bigint").cast("string"))
    dashed = [part for key in keys for part in (F.lit("-"), key)][1:]
    return F.concat(F.lit("O"), *dashed)


def _customer_id(key: str) -> Column:
    return F.when(_fault("customer", key), "C999X").otherwise(F.concat(F.lit("C"), "o_custkey"))


def _status() -> Column:
    known = (
        F.when(F.col("o_orderstatus") == "F", "Paid")
        .when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "Overdue")
    )
    return F.when(_fault("status"), "pending").otherwise(known)


class StarSource:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A source table; its schema is looked up in the files once per process."""
        file = f"{self.path}/{name}.parquet"
        if file not in _schemas:
            _schemas[file] = self.spark.read.parquet(file).schema
        return self.spark.read.schema(_schemas[file]).parquet(file)

    @property
    def customers(self) -> DataFrame:
        # The 25 nations come in as one map value. As a join they would make Spark take the
        # customers for far too large to broadcast.
        nations = self.table("nation").agg(
            F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name")))
        )
        return self.table("customer").select(
            F.concat(F.lit("C"), "c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.try_element_at(nations.scalar(), F.col("c_nationkey")).alias("city"),
            F.col("c_mktsegment").alias("customer_type"),
            F.lit(None).cast("date").alias("join_date"),
        )

    @property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("product_id"),
            F.concat_ws(" ", "p_name", "p_partkey").alias("product_name"),
            F.col("p_type").alias("category"),
        )

    def orders_raw(self, columns: Iterable[str] = ORDER_COLUMNS) -> DataFrame:
        return self._orders(self.table("lineitem").withColumn("_again", F.lit(0)), columns)

    def deliveries(self, columns: Iterable[str] = ORDER_COLUMNS) -> DataFrame:
        """``orders_raw`` as it comes in, before lines that were sent twice are sorted out."""
        once, same, changed = (F.array(*map(F.lit, times)) for times in ((0,), (0, 0), (0, 1)))
        times = F.when(_hit(SENT_AGAIN["changed"]), changed).when(_hit(SENT_AGAIN["same"]), same).otherwise(once)
        return self._orders(self.table("lineitem").withColumn("_again", F.explode(times)), columns)

    def orders_with_customers(self) -> DataFrame:
        """``orders_raw`` with ``add_customer``: the customer belongs to the order, so the orders meet
        the customers and the wide lines need not be shuffled for them."""
        lines = self.table("lineitem").withColumn("_again", F.lit(0))
        return unknown_customers(self._orders(lines, ORDER_COLUMNS, self.customers))

    def _orders(self, rows: DataFrame, columns: Iterable[str], customers: DataFrame | None = None) -> DataFrame:
        """``rows``: lines with ``_again``, which is added to their discount. With ``customers``, the
        columns of ``add_customer`` too, missing for lines without an order."""
        wanted = set(columns)
        if wanted & ORDER_LEVEL:
            orders = self.table("orders").select(
                "o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus"
            )
            if customers is not None:
                orders = add_customer(orders.withColumn("customer_id", _customer_id("o_orderkey")), customers).drop("customer_id")
            rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        if "salesperson" in wanted:
            supplier = self.table("supplier").select("s_suppkey", "s_name")
            rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        # The price joins on the product id the order line shows, so a faulty id finds no
        # price, and a later join on product_id needs no second shuffle of the lines.
        rows = rows.withColumns(
            {
                "product_id": F.when(_fault("product"), "P999X").otherwise(
                    F.concat(F.lit("P"), "l_partkey")
                ),
                "quantity": F.when(_fault("quantity"), -3).otherwise(
                    F.col("l_quantity").cast("int")
                ),
                "discount_pct": F.when(_fault("discount"), F.lit(35).cast(PERCENT)).otherwise(
                    (F.round(F.col("l_discount") * 200) + F.col("_again")).cast(PERCENT)
                ),
            }
        )
        if wanted & set(MONEY_COLUMNS):
            rows = self._with_money(rows)
        # Behind the joins, which shuffle the numbers that texts are made of.
        more = CUSTOMER_COLUMNS if customers is not None else ()
        return rows.withColumns(self._plain(wanted)).select(*[c for c in ORDERS_RAW.names if c in wanted], *more)

    def _plain(self, wanted: set[str]) -> dict[str, Column]:
        columns = {
            "order_id": _order_id,
            "order_date": lambda: F.col("o_orderdate").cast("date"),
            "customer_id": lambda: _customer_id("l_orderkey"),
            "payment_status": _status,
            "salesperson": lambda: F.col("s_name"),
        }
        return {name: value() for name, value in columns.items() if name in wanted}

    def _with_money(self, rows: DataFrame) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(12,2)")
        margin_key = (70 + F.col("p_partkey") % 20).cast("decimal(3,0)")
        prices = self.table("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("product_id"),
            _raw_money(price).alias("selling_price"),
            _raw_money(price * margin_key * F.lit("0.01").cast("decimal(3,2)")).alias("unit_cost"),
        )
        rate = F.col("discount_pct") * F.lit("0.01").cast("decimal(3,2)")
        return (
            rows.join(prices, "product_id", "left")
            .withColumns(
                {
                    "gross_sales": _raw_money(F.col("quantity") * F.col("selling_price") + _slip("gross")),
                    "cost": _raw_money(F.col("quantity") * F.col("unit_cost") + _slip("cost")),
                }
            )
            .withColumn("discount_amount", _raw_money(F.col("gross_sales") * rate))
            .withColumn("net_sales", _raw_money(F.col("gross_sales") - F.col("discount_amount") + _slip("net")))
            .withColumn("profit", _raw_money(F.col("net_sales") - F.col("cost") + _slip("profit")))
        )
