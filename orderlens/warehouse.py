"""The tables a report reads, either planned from the source or read from written tables.

``LiveSales`` writes nothing: ``facts("net_sales")`` plans just the joins and columns that
one column needs. ``build`` writes the cleaned table once and ``StoredSales`` reads it, so
that many reports share one cleaning run. Reports that add up measures per key (``summed``,
``with_customers``, ``slices``) read small sums that ``build`` wrote as well, where those hold
the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlens.operators import cleaning, measures, quality, validation
from orderlens.operators.measures import KEYS, MEASURES, Where
from orderlens.schema import CLEAN_COLUMNS, CUSTOMERS, ORDER_COLUMNS, ORDERS_RAW, PRODUCTS
from orderlens.sources import versions
from orderlens.sources.star import StarSource
from orderlens.sources.tables import require_unique_masters, write_tables


class LiveSales:
    """Tables planned on demand. ``source`` has ``customers``, ``products`` and
    ``orders_raw(columns)``."""

    def __init__(self, source):
        self.source = source

    @property
    def customers(self) -> DataFrame:
        return self.source.customers

    @property
    def products(self) -> DataFrame:
        return self.source.products

    def raw(self, *columns: str) -> DataFrame:
        return self.source.orders_raw(columns or ORDER_COLUMNS)

    def deliveries(self, *columns: str) -> DataFrame:
        """Raw rows as they come in, rows that come twice among them: the quality rules' input."""
        columns = columns or ORDER_COLUMNS
        return getattr(self.source, "deliveries", self.source.orders_raw)(columns)

    def facts(self, *columns: str) -> DataFrame:
        """Cleaned order lines with the asked order and derived columns."""
        raw = self.source.orders_raw(cleaning.inputs_of(columns))
        return cleaning.clean_orders(raw, self.products, columns)

    def lines(self, *columns: str) -> DataFrame:
        """``facts`` before the lines of unknown products go: a report that sums per product id
        drops them there, where a product is one row."""
        return cleaning.clean_lines(self.source.orders_raw(cleaning.inputs_of(columns)), columns)

    def clean(self) -> DataFrame:
        if hasattr(self.source, "orders_with_customers"):
            return cleaning.clean_with_customers(self.source.orders_with_customers(), self.products)
        return cleaning.build_clean(self.raw(), self.customers, self.products)

    def summed(self, keys: Sequence[str], names: Sequence[str], where: Where | None = None) -> DataFrame:
        """Measures (``orderlens.operators.measures``) per key over the cleaned lines that
        ``where`` picks by salesperson or category."""
        return measures.sum_lines(self, keys, names, where or {})

    def with_customers(self, names: Sequence[str], where: Where | None = None) -> DataFrame:
        """One row: the measures and the number of active customers."""
        return measures.with_customers(self.summed(["customer_id"], names, where), names)

    def slices(self, names: Sequence[str]) -> DataFrame:
        """Measures and customers (as bitmaps or marks) per salesperson, category and block of customers."""
        keys = ["salesperson", "category"]
        lines = self.lines("product_id", "salesperson", "customer_id")
        pairs = lines.join(self.products.select("product_id", "category"), "product_id")
        return measures.customer_slices(self.summed(keys, names), pairs.select(*keys, "customer_id"), keys, names)


class GivenTables:
    """A source made of three ready DataFrames."""

    def __init__(
        self, orders_raw: DataFrame, customers: DataFrame, products: DataFrame, rejects: DataFrame | None = None
    ):
        self.orders, self.customers, self.products = orders_raw, customers, products
        self.rejects = rejects

    def orders_raw(self, columns=ORDER_COLUMNS) -> DataFrame:
        wanted = set(columns)
        return self.orders.select(*[c for c in ORDER_COLUMNS if c in wanted])


def marked_schema(spark: SparkSession) -> StructType:
    """What ``cleaning.build_marked`` gives; its folders' names would be read as dates."""
    given = [spark.createDataFrame([], schema) for schema in (ORDERS_RAW, CUSTOMERS, PRODUCTS)]
    return cleaning.build_marked(*given).schema


# Sums that ``build`` writes: name -> keys, the likely smallest first.
ROLLUPS = {
    "by_discount": ("discount_pct", "payment_status"),
    "by_month": ("month", "category"),
    "by_salesperson": ("salesperson", "category", "payment_status"),
    "by_product": ("product_id",),
    "by_customer": ("customer_id", "payment_status"),
}
SLICES = "by_customer_block"


class StoredSales:
    """Tables written by ``build``: the version that is current when this is made. Column pruning
    happens in the Parquet scan; ``clean`` lies in a folder per removal reason and month, so a
    filter on ``year_month`` reads that month only."""

    def __init__(self, spark: SparkSession, path: str, folder: str | None = None):
        """``folder``: a version that is not, or no longer, the current one."""
        self.spark, self.path = spark, folder or versions.current(spark, path)

    def _read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    @property
    def customers(self) -> DataFrame:
        return self._read("customers", CUSTOMERS)

    @property
    def products(self) -> DataFrame:
        return self._read("products", PRODUCTS)

    def raw(self, *columns: str) -> DataFrame:
        return self._read("orders_raw", ORDERS_RAW).select(*(columns or ORDER_COLUMNS))

    def deliveries(self, *columns: str) -> DataFrame:
        return self.raw(*columns)

    def marked(self) -> DataFrame:
        """Kept and removed rows with ``removed_for``."""
        return self._read("clean", marked_schema(self.spark))

    def facts(self, *columns: str) -> DataFrame:
        return self.marked().filter(F.col("removed_for") == cleaning.KEPT).select(*columns)

    def log(self, name: str) -> DataFrame:
        """``cleaning_log``, ``validation``, ``rejects``, ``quality_log`` or ``quality_log_ids``."""
        return self._read(name)

    def lines(self, *columns: str) -> DataFrame:
        return self.facts(*columns)

    def clean(self) -> DataFrame:
        return self.facts(*CLEAN_COLUMNS)

    def _from_lines(self, keys: Sequence[str], names: Sequence[str], where: Where) -> DataFrame:
        """From ``clean``, which has the category and no unknown product: no join."""
        lines = self.facts(*measures.columns_of([*keys, *where], names))
        return measures.summed(measures.picked(lines, where), keys, names)

    def summed(self, keys: Sequence[str], names: Sequence[str], where: Where | None = None) -> DataFrame:
        """From the first written sums that hold the keys, else from the cleaned lines."""
        where = where or {}
        asked = {"month" if k in KEYS else k for k in [*keys, *where]}
        for name, held in ROLLUPS.items():
            if asked <= set(held):
                sums = measures.picked(self._read(f"sums/{name}"), where)
                if "month" in held:  # a month's first day has the quarter and month of its orders
                    sums = measures.with_keys(sums.withColumn("order_date", F.col("month")), keys)
                return measures.added(sums, keys, names)
        return self._from_lines(keys, names, where)

    def slices(self, names: Sequence[str]) -> DataFrame:
        slices = self._read(f"sums/{SLICES}")
        return slices.drop(*[m for m in MEASURES if m not in names])

    def with_customers(self, names: Sequence[str], where: Where | None = None) -> DataFrame:
        where = where or {}
        return measures.counted(measures.picked(self.slices(names), where), [], names, where)


Sales = LiveSales | StoredSales


def from_star(spark: SparkSession, path: str) -> LiveSales:
    return LiveSales(StarSource(spark, path))


def from_tables(
    orders_raw: DataFrame, customers: DataFrame, products: DataFrame, rejects: DataFrame | None = None
) -> LiveSales:
    """``rejects`` are the input rows that could not be read (``sources.tables.read_inputs``);
    ``build`` keeps them beside the tables."""
    return LiveSales(GivenTables(orders_raw, customers, products, rejects))


def written_sums(stored: StoredSales) -> dict[str, DataFrame]:
    """The sums ``StoredSales`` answers from, each one aggregation of the written clean table."""
    names = tuple(MEASURES)
    found = {name: stored._from_lines(keys, names, {}) for name, keys in ROLLUPS.items()}
    keys = ["salesperson", "category"]
    sums = stored._from_lines(keys, names, {})
    found[SLICES] = measures.customer_slices(sums, stored.facts(*keys, "customer_id"), keys, names)
    return found


def write_clean(stored: StoredSales) -> tuple[DataFrame, DataFrame]:
    """Write every raw row, cleaned and marked, and return the cleaning log and the verdicts of the
    rules on single rows. Both are counted while the rows are written, at the top of the plan,
    where Spark counts each written partition once."""
    spark, seen = stored.spark, Observation()
    marked = cleaning.build_marked(stored.raw(), stored.customers, stored.products)
    kept = F.col("removed_for") == cleaning.KEPT
    # One shuffle: AQE splits large months and joins small ones, so files have one size.
    months = marked.hint("rebalance", "removed_for", "year_month")
    counted = months.observe(seen, *cleaning.removal_metrics(), *validation.row_metrics(kept))
    counted.write.partitionBy("removed_for", "year_month").parquet(f"{stored.path}/clean")
    counts = spark.createDataFrame([seen.get])
    return cleaning.log_rows(counts), validation.row_verdicts(spark, seen.get)


def build(
    sales: LiveSales, path: str, years: tuple[int, int], quality_log: bool = True
) -> StoredSales:
    """Write raw, clean and master tables, logs and sums to a new folder, check them, then make
    that folder the current version of ``path``.

    A table that fails a check stops the build before anything is published: readers keep the
    version they had. The narrow ``orders`` table is the first 15 columns' worth of ``clean``;
    it is a projection at read time, not a second copy.
    """
    spark = sales.customers.sparkSession
    folder = versions.new_folder(path)
    write_tables({"customers": sales.customers, "products": sales.products}, folder)
    stored = StoredSales(spark, path, folder)
    require_unique_masters(stored.customers, stored.products)
    rejects = getattr(sales.source, "rejects", None)
    if rejects is not None:
        write_tables({"rejects": rejects}, folder)
    write_tables({"orders_raw": sales.raw()}, folder)
    log, verdicts = write_clean(stored)
    verdicts = verdicts.unionByName(validation.unique_ids(stored.facts("order_id")))
    verdicts = verdicts.unionByName(validation.products_known(stored.facts("product_id"), stored.products))
    write_tables({"cleaning_log": log, "validation": verdicts}, folder)
    validation.require_passed(stored.log("validation"))
    write_tables(written_sums(stored), f"{folder}/sums")
    if quality_log:
        tables = (stored.raw(), stored.customers, stored.products, years)
        logs = {"quality_log": quality.summary(*tables), "quality_log_ids": quality.id_pages(*tables)}
        write_tables(logs, folder)
    versions.publish(spark, path, folder)
    return StoredSales(spark, path)
