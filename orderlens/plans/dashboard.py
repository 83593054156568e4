"""The dashboard's selections: every combination of salesperson and category."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import dbl
from orderlens.operators.measures import AMOUNTS, Where, has_marks, mark
from orderlens.plans.sql_reports import kpi_columns
from orderlens.warehouse import Sales

CUBE_MEASURES = ("orders", "net_rows", "losses", *AMOUNTS)


def cube(sales: Sales) -> DataFrame:
    """The eleven headline figures for each selection, also for "all". A missing key is not
    "all": the two flags tell them apart. The cube runs on slices (salesperson, category, block
    of customers), not on the lines: blocks keep their bitmaps apart, so that the bitmaps of one
    block are united through the cube and the bits of all blocks add up to distinct customers.
    Slices of many groups have marks in place of bitmaps: each selection adds up its own."""
    person, kind, block = keys = ("salesperson", "category", "block")
    slices = sales.slices(CUBE_MEASURES)
    selection = (person, kind, "all_salespeople", "all_categories")
    if has_marks(slices):
        return _figures(_marked_cube(slices), selection)
    blocks = (
        slices.groupingSets([[person, kind, block], [person, block], [kind, block], [block]], *keys)
        .agg(
            (F.grouping(person) == 1).alias("all_salespeople"),
            (F.grouping(kind) == 1).alias("all_categories"),
            *[F.sum(m).alias(m) for m in CUBE_MEASURES],
            F.bitmap_count(F.bitmap_or_agg("customers")).alias("customers"),
        )
    )
    totals = blocks.groupBy(*selection).agg(*[F.sum(m).alias(m) for m in (*CUBE_MEASURES, "customers")])
    return _figures(totals, selection)


def _marked_cube(slices: DataFrame) -> DataFrame:
    keys = ("salesperson", "category")
    choices = [[*keys], [keys[0]], [keys[1]], []]
    totals = slices.groupingSets(choices, *keys).agg(
        (F.grouping(keys[0]) == 1).alias("all_salespeople"),
        (F.grouping(keys[1]) == 1).alias("all_categories"),
        *[F.sum(m).alias(m) for m in (*CUBE_MEASURES, *map(mark, choices))],
    )
    for_all_kinds = F.when(F.col("all_salespeople"), F.col(mark([]))).otherwise(F.col(mark(keys[:1])))
    for_a_kind = F.when(F.col("all_salespeople"), F.col(mark(keys[1:]))).otherwise(F.col(mark(keys)))
    customers = F.when(F.col("all_categories"), for_all_kinds).otherwise(for_a_kind)
    return totals.withColumn("customers", F.coalesce(customers, F.lit(0)))


def _figures(totals: DataFrame, selection: tuple[str, ...]) -> DataFrame:
    return totals.select(
        *selection,
        *kpi_columns(),
        dbl("cost").alias("total_cost"),
        F.col("customers").alias("active_customers"),
        F.col("losses").alias("loss_orders"),
    )


class Selection:
    """The sales of one salesperson and/or category. Every report and chart takes it in place
    of the whole sales; ``None`` selects all."""

    def __init__(self, sales: Sales, salesperson: str | None = None, category: str | None = None):
        self.sales, self.salesperson, self.category = sales, salesperson, category
        self.customers, self.products = sales.customers, sales.products

    def _pick(self, lines: DataFrame) -> DataFrame:
        if self.salesperson is not None:
            lines = lines.filter(F.col("salesperson") == self.salesperson)
        if self.category is not None:
            chosen = self.products.filter(F.col("category") == self.category)
            lines = lines.join(chosen.select("product_id"), "product_id", "left_semi")
        return lines

    def facts(self, *columns: str) -> DataFrame:
        return self._chosen(self.sales.facts, columns)

    def lines(self, *columns: str) -> DataFrame:
        return self._chosen(self.sales.lines, columns)

    def _chosen(self, source: Callable[..., DataFrame], columns: tuple[str, ...]) -> DataFrame:
        keys = [*(["salesperson"] if self.salesperson is not None else [])]
        keys += ["product_id"] if self.category is not None else []
        needed = dict.fromkeys([*columns, *keys])
        return self._pick(source(*needed)).select(*columns)

    def clean(self) -> DataFrame:
        clean = self.sales.clean()
        return self._pick(clean).select(*clean.columns)

    def _where(self, more: Where | None) -> dict[str, object]:
        mine = {"salesperson": self.salesperson, "category": self.category}
        return {k: v for k, v in mine.items() if v is not None} | dict(more or {})

    def summed(self, keys: Sequence[str], names: Sequence[str], where: Where | None = None) -> DataFrame:
        return self.sales.summed(keys, names, self._where(where))

    def with_customers(self, names: Sequence[str], where: Where | None = None) -> DataFrame:
        return self.sales.with_customers(names, self._where(where))
