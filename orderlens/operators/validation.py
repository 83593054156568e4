"""Rules the cleaned table must pass. Each gives one row (rule, passed, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.columns import or_false
from orderlens.operators.quality import duplicate_ids
from orderlens.schema import MONEY_COLUMNS, STATUSES


def _verdict(counted: DataFrame, rule: str) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return counted.select(
        F.lit(rule).alias("rule"), (n == 0).alias("passed"), n.alias("violations")
    )


def _count(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n"))


def unique_ids(clean: DataFrame) -> DataFrame:
    """Ids that are repeated."""
    return _verdict(duplicate_ids(clean).agg(F.count("*").alias("n")), "order_id is unique")


def money_present(clean: DataFrame) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in MONEY_COLUMNS])
    return _verdict(_count(clean, missing), "no missing money")


def quantity_positive(clean: DataFrame) -> DataFrame:
    return _verdict(_count(clean, ~or_false(F.col("quantity") > 0)), "quantity is positive")


def status_set(clean: DataFrame) -> DataFrame:
    """The statuses found are exactly the expected ones: foreign rows and absent statuses
    both count."""
    status = F.col("payment_status")
    foreign = F.count_if(F.coalesce(~status.isin(*STATUSES), F.lit(True)))
    absent = [(F.count_if(status == s) == 0).cast("bigint") for s in STATUSES]
    return _verdict(
        clean.agg(reduce(lambda a, b: a + b, absent, foreign).alias("n")),
        "payment_status is Paid, Pending, Overdue",
    )


def products_known(clean: DataFrame, products: DataFrame) -> DataFrame:
    per_product = clean.groupBy("product_id").agg(F.count("*").alias("rows"))
    unknown = per_product.join(products.select("product_id"), "product_id", "left_anti")
    return _verdict(unknown.agg(F.sum("rows").alias("n")), "product_id is known")


def row_metrics(kept: Column) -> list[Column]:
    """What the rules that look at one row count, as aggregates over the rows that ``kept`` holds
    for: measured with ``DataFrame.observe`` while the table is written."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in MONEY_COLUMNS])
    status = F.col("payment_status")
    foreign = F.coalesce(~status.isin(*STATUSES), F.lit(True))
    return [
        F.count_if(kept).alias("rows"),
        F.count_if(kept & missing).alias("money"),
        F.count_if(kept & ~or_false(F.col("quantity") > 0)).alias("quantity"),
        F.count_if(kept & foreign).alias("foreign"),
        *[F.count_if(kept & (status == s)).alias(f"status_{s}") for s in STATUSES],
    ]


def row_verdicts(spark: SparkSession, metrics: dict[str, int]) -> DataFrame:
    """The verdicts of ``row_metrics``, in the shape of the other rules."""
    absent = sum(metrics[f"status_{s}"] == 0 for s in STATUSES)
    counts = (
        ("no missing money", metrics["money"]),
        ("quantity is positive", metrics["quantity"]),
        ("payment_status is Paid, Pending, Overdue", metrics["foreign"] + absent),
    )
    return spark.createDataFrame([(r, n == 0, n) for r, n in counts], "rule string, passed boolean, violations long")


def validate(clean: DataFrame, products: DataFrame) -> DataFrame:
    parts = [
        unique_ids(clean),
        money_present(clean),
        quantity_positive(clean),
        status_set(clean),
        products_known(clean, products),
    ]
    return reduce(DataFrame.unionByName, parts)


def require_passed(verdicts: DataFrame) -> None:
    """Stop the job if a rule fails (a row per rule comes to the driver)."""
    failed = [r for r in verdicts.collect() if not r.passed]
    if failed:
        text = "; ".join(f"{r.rule}: {r.violations} violations" for r in failed)
        raise ValueError(f"cleaned orders are not valid - {text}")


def require_valid(clean: DataFrame, products: DataFrame) -> None:
    require_passed(validate(clean, products))
