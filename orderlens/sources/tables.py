"""Reading and writing the model's own tables (one folder per table)."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schema import CUSTOMERS, ORDER_COLUMNS, ORDERS_RAW, PRODUCTS

INPUT_SCHEMAS = {"orders": ORDERS_RAW, "customers": CUSTOMERS, "products": PRODUCTS}
# Keep blanks at the ends of text as they are; cleaning decides about them.
CSV_WRITE = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
RECORD = "_record"
WRONG_WIDTH = "number of fields"
RELATIONAL = ("orders_raw", "orders", "customers", "products")
VERSION = "orderlens.version"
MASTER_KEYS = {"customers": "customer_id", "products": "product_id"}


def _as_missing(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """Not-a-number, also as the text of a number column, is a missing value: further on a
    comparison with it would be true in Spark."""
    if isinstance(source, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(source, T.StringType) and isinstance(target, T.NumericType):
        return F.when(F.upper(F.trim(column)) != "NAN", column)
    return column


def _checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``given`` (the row as read), ``typed`` (cast to ``schema``) and ``bad``, the names of the
    columns whose value does not fit their type."""
    typed, bad = [], []
    for field in schema:
        value = _as_missing(F.col(field.name), df.schema[field.name].dataType, field.dataType)
        if isinstance(df.schema[field.name].dataType, T.StringType) and isinstance(field.dataType, T.DateType):
            cast = F.try_to_date(value, "yyyy-MM-dd")
        else:
            cast = value.try_cast(field.dataType)
        typed.append(cast.alias(field.name))
        bad.append(F.when(value.isNotNull() & cast.isNull(), F.lit(field.name)))
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"),
        F.struct(*typed).alias("typed"),
        F.array_compact(F.array(*bad)).alias("bad"),
    )


def _rows(spark: SparkSession, path: str, name: str, fmt: str) -> DataFrame:
    """One input table, every row checked: ``record`` (text of the row), ``typed`` and ``bad``.

    Delimited text is read as text and cast here: the reader itself would judge a row only by
    the columns that a query happens to read.
    """
    schema = INPUT_SCHEMAS[name]
    if fmt != "csv":
        checked = _checked(spark.read.format(fmt).load(f"{path}/{name}"), schema)
        return checked.select(F.to_json("given").alias("record"), "typed", "bad")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*schema.names, RECORD]])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": False}
    checked = _checked(spark.read.schema(texts).options(**options).csv(f"{path}/{name}"), schema)
    broken = F.col(f"given.{RECORD}")
    fields = F.concat_ws(",", *[F.coalesce(f"given.{n}", F.lit("")) for n in schema.names])
    return checked.select(
        F.coalesce(broken, fields).alias("record"),
        "typed",
        F.when(broken.isNotNull(), F.array(F.lit(WRONG_WIDTH))).otherwise(F.col("bad")).alias("bad"),
    )


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """The readable rows of one input table, with its fixed schema, from ``<path>/<name>``."""
    return _rows(spark, path, name, fmt).filter(F.size("bad") == 0).select("typed.*")


def read_rejects(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The other rows of all input tables: table, reason (the columns that don't fit their type,
    or a wrong number of fields) and the row as text."""
    parts = [
        _rows(spark, path, name, fmt)
        .filter(F.size("bad") > 0)
        .select(F.lit(name).alias("table"), F.array_join("bad", ", ").alias("reason"), "record")
        for name in INPUT_SCHEMAS
    ]
    return reduce(DataFrame.unionByName, parts)


def read_inputs(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The readable rows of each table, and ``rejects``, the rows that none of them holds."""
    tables = {name: read_table(spark, path, name, fmt) for name in INPUT_SCHEMAS}
    return tables | {"rejects": read_rejects(spark, path, fmt)}


def bad_master_keys(master: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or repeated; the joins need none of them."""
    return master.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull())


def require_unique_masters(customers: DataFrame, products: DataFrame) -> None:
    for name, master in (("customers", customers), ("products", products)):
        bad = bad_master_keys(master, MASTER_KEYS[name]).take(1)
        if bad:
            raise ValueError(f"{name}: missing or repeated key {bad[0][0]!r}")


def text_flags(df: DataFrame) -> DataFrame:
    """Booleans as ``True``/``False`` text, as in the exported CSV."""
    flags = {
        f.name: F.initcap(F.col(f.name).cast("string"))
        for f in df.schema
        if isinstance(f.dataType, T.BooleanType)
    }
    return df.withColumns(flags)


def write_clean_csv(clean: DataFrame, path: str) -> None:
    """The cleaned table as CSV part files with headers, sorted by order id across the parts."""
    rows = text_flags(clean.orderBy("order_id"))
    rows.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each table under ``path``, replacing what is there."""
    for name, df in tables.items():
        options = CSV_WRITE if fmt == "csv" else {}
        df.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/{name}")


def _kinds(spark: SparkSession, database: str) -> dict[str, str]:
    """Names and kinds of a database's tables and views, without the session's own views."""
    return {t.name: t.tableType for t in spark.catalog.listTables(database) if not t.isTemporary}


def save_relational(
    orders_raw: DataFrame,
    clean: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    database: str = "default",
) -> None:
    """Rebuild the four catalog tables that SQL reports read.

    All four are written under names of this version first; only then do the views that readers
    use move over, which touches no data. A write that fails leaves the views as they were.
    """
    spark = orders_raw.sparkSession
    tables = {
        "orders_raw": orders_raw,
        "orders": clean.select(*ORDER_COLUMNS),
        "customers": customers,
        "products": products,
    }
    version = uuid.uuid4().hex[:12]
    try:
        for name, df in tables.items():
            df.write.format("parquet").saveAsTable(f"{database}.{name}_{version}")
    except Exception:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}_{version}")
        raise
    kinds = _kinds(spark, database)
    for name in tables:
        if kinds.get(name, "VIEW") != "VIEW":
            spark.sql(f"DROP TABLE {database}.{name}")  # of a time before versions
        spark.sql(
            f"CREATE OR REPLACE VIEW {database}.{name} TBLPROPERTIES ('{VERSION}' = '{version}')"
            f" AS SELECT * FROM {database}.{name}_{version}"
        )


def unread_versions(spark: SparkSession, database: str = "default") -> list[str]:
    """Version tables that no view of ``save_relational`` reads any more: what may be dropped."""
    kinds = _kinds(spark, database)
    views = [n for n in RELATIONAL if kinds.get(n) == "VIEW"]
    read = {f"{n}_{spark.sql(f"SHOW TBLPROPERTIES {database}.{n}('{VERSION}')").first()['value']}" for n in views}
    written = rf"({'|'.join(RELATIONAL)})_[0-9a-f]{{12}}"
    return sorted(n for n, kind in kinds.items() if kind != "VIEW" and re.fullmatch(written, n) and n not in read)


def register_views(
    orders_raw: DataFrame, clean: DataFrame, customers: DataFrame, products: DataFrame
) -> None:
    """The same four tables as temporary views, without writing anything."""
    orders_raw.createOrReplaceTempView("orders_raw")
    clean.select(*ORDER_COLUMNS).createOrReplaceTempView("orders")
    customers.createOrReplaceTempView("customers")
    products.createOrReplaceTempView("products")
