"""Data-quality rules on the raw orders.

Each rule alone returns the ids it flags. ``violations`` runs all of them together: the
rules that look at one row share a single pass, the duplicate rules share one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import or_false
from orderlens.operators.ordering import repeat_rows, running_before, small_side
from orderlens.schema import MONEY_TOLERANCE, OUTLIER_DISCOUNT, STATUSES, literal_rows


def has_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def bad_status() -> Column:
    return F.coalesce(~F.col("payment_status").isin(*STATUSES), F.lit(True))


def differs(left: Column, right: str) -> Column:
    return or_false(F.abs(left - F.col(right)) > F.lit(MONEY_TOLERANCE).cast("decimal(3,2)"))


def gross_differs() -> Column:
    return differs(F.col("quantity") * F.col("selling_price"), "gross_sales")


def net_differs() -> Column:
    return differs(F.col("gross_sales") - F.col("discount_amount"), "net_sales")


def profit_differs() -> Column:
    return differs(F.col("net_sales") - F.col("cost"), "profit")


def cost_differs() -> Column:
    return differs(F.col("quantity") * F.col("unit_cost"), "cost")


def outside_years(first: int, last: int) -> Column:
    """Order year outside the expected span; a missing date is outside."""
    return ~or_false(F.year("order_date").between(first, last))


def ids_where(orders: DataFrame, condition: Column) -> DataFrame:
    return orders.filter(condition).select("order_id")


def iqr_fence(orders: DataFrame) -> DataFrame:
    """One row: quartiles and upper fence of the discount. Rows are counted per value first;
    the column's type admits two million values at most, all that ``percentile`` sees."""
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    values = orders.groupBy("discount_pct").agg(F.count("*").alias("n"))
    spread = values.agg(F.percentile("discount_pct", quartiles, F.col("n")).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return spread.select(q1.alias("q1"), q3.alias("q3"), (q3 + 1.5 * (q3 - q1)).alias("fence"))


def above_fence(discounts: DataFrame) -> Column:
    fence = iqr_fence(discounts).select("fence").scalar()
    return or_false(F.col("discount_pct").cast("double") > fence)


def iqr_outliers(orders: DataFrame) -> DataFrame:
    fence = iqr_fence(orders.select("discount_pct")).select("fence").scalar()
    return (
        orders.select("order_id", F.col("discount_pct").cast("double"), fence.alias("fence"))
        .filter(F.col("discount_pct") > F.col("fence"))
        .select("order_id", "fence")
    )


def missing_in(orders: DataFrame, master: DataFrame, key: str) -> DataFrame:
    return orders.join(master.select(key), key, "left_anti").select("order_id")


Code = Callable[..., Column]


def repeat_candidates(rows: DataFrame, key: str, code: Code = F.xxhash64) -> DataFrame:
    """The rows whose ``key`` may occur more than once, with all their columns.

    First phase: only 8-byte codes of the keys are shuffled. Codes that repeat are few where
    repeats are; the rows that have one are found without a shuffle of the rows. Equal keys have
    equal codes, so no repeat is lost; what else shares a code is sorted out by whoever groups
    the candidates by the key itself.
    """
    codes = rows.select(code(key).alias("_code")).groupBy("_code").agg(F.count("*").alias("_n"))
    repeated = small_side(codes.filter("_n > 1").select("_code"))
    return rows.join(repeated, code(key) == F.col("_code"), "left_semi")


def duplicate_ids(orders: DataFrame, key: str = "order_id", code: Code = F.xxhash64) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    candidates = repeat_candidates(orders.select(key), key, code)
    return candidates.groupBy(key).agg(F.count("*").alias("cnt")).filter(F.col("cnt") > 1)


def repeated_ids(orders: DataFrame, key: str = "order_id", code: Code = F.xxhash64) -> DataFrame:
    """The id of every second and later occurrence."""
    extra = duplicate_ids(orders, key, code).select(key, (F.col("cnt") - 1).alias("copies"))
    return repeat_rows(extra, "copies", "_copy").select(key)


def _copies_per_id(orders: DataFrame, code: Code = F.xxhash64) -> DataFrame:
    """(order_id, id_copies, row_copies): further occurrences of an id and of a whole row, for
    the ids that repeat.

    A repeated row repeats its id, so whole rows are compared (all columns, missing equal to
    missing) only among the rows of candidate ids.
    """
    columns = orders.columns
    same = repeat_candidates(orders, "order_id", code).groupBy(*columns).agg(F.count("*").alias("cnt"))
    per_id = same.groupBy("order_id").agg(
        (F.sum("cnt") - 1).alias("id_copies"), F.sum(F.col("cnt") - 1).alias("row_copies")
    )
    return per_id.filter(F.col("id_copies") > 0)


def repeated_rows(orders: DataFrame, code: Code = F.xxhash64) -> DataFrame:
    """The id of every second and later occurrence of a whole row."""
    extra = _copies_per_id(orders, code).filter(F.col("row_copies") > 0)
    return repeat_rows(extra, "row_copies", "_copy").select("order_id")


def orphans(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Orders whose customer or product is in no master, saying which."""
    known_customer = customers.select("customer_id", F.lit(True).alias("_customer"))
    known_product = products.select("product_id", F.lit(True).alias("_product"))
    no_customer, no_product = F.col("_customer").isNull(), F.col("_product").isNull()
    return (
        orders.select("order_id", "customer_id", "product_id")
        .join(known_product, "product_id", "left")
        .join(known_customer, "customer_id", "left")
        .filter(no_customer | no_product)
        .select(
            "order_id",
            "customer_id",
            "product_id",
            F.when(no_customer, "Missing customer").alias("customer_issue"),
            F.when(no_product, "Missing product").alias("product_issue"),
        )
    )


def invalid_values(orders: DataFrame) -> DataFrame:
    issue = (
        F.when(F.col("net_sales").isNull(), "Missing sales values")
        .when(F.col("quantity") <= 0, "Invalid quantity")
        .when(F.col("discount_pct") > OUTLIER_DISCOUNT, "Discount outlier")
    )
    return orders.select(
        "order_id", "quantity", "discount_pct", "net_sales", issue.alias("issue")
    ).filter(F.col("issue").isNotNull())


def status_spelling(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("payment_status").agg(F.count("*").alias("orders"))
    return counts.orderBy(F.desc("orders"), F.col("payment_status").asc_nulls_first())


# --- all rules together -----------------------------------------------------------------

# Fixed names of the checks, in log order. {fence} and {years} are filled in.
CHECKS = (
    "Missing values (any column)",
    "Duplicate order_id",
    "Fully duplicated rows",
    "Invalid payment_status spelling/case",
    "Quantity <= 0",
    "Discount outlier (> {fence}% IQR fence)",
    "customer_id not in Customers",
    "product_id not in Products",
    "gross_sales != qty x price",
    "net_sales != gross - discount",
    "profit != net - cost",
    "Order date outside {years}",
)


def check_names(discounts: DataFrame, years: tuple[int, int]) -> DataFrame:
    """The twelve checks as rows (check_no, check_name)."""
    fence = iqr_fence(discounts).select("fence").scalar()
    whole = F.bround(fence, 0).cast("bigint").cast("string")
    span = str(years[0]) if years[0] == years[1] else f"{years[0]}-{years[1]}"
    rows = []
    for number, text in enumerate(CHECKS, 1):
        if "{fence}" in text:
            before, after = text.split("{fence}")
            name = F.concat(F.lit(before), F.coalesce(whole, F.lit("nan")), F.lit(after))
        else:
            name = F.lit(text.replace("{years}", span))
        rows.append((number, name))
    return literal_rows(discounts.sparkSession, ("check_no", "check_name"), rows)


def _row_rules(orders: DataFrame, years: tuple[int, int], discounts: DataFrame) -> dict[int, Column]:
    """The checks that look at one row, joined with what ``_with_masters`` adds."""
    return {
        1: has_missing(orders.columns),
        4: bad_status(),
        5: or_false(F.col("quantity") <= 0),
        6: above_fence(discounts),
        7: F.col("_customer").isNull(),
        8: F.col("_product").isNull(),
        9: gross_differs(),
        10: net_differs(),
        11: profit_differs(),
        12: outside_years(*years),
    }


def _with_masters(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    known_product = products.select("product_id", F.lit(True).alias("_product"))
    known_customer = customers.select("customer_id", F.lit(True).alias("_customer"))
    return orders.join(known_product, "product_id", "left").join(known_customer, "customer_id", "left")


def violation_counts(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    years: tuple[int, int],
    discounts: DataFrame | None = None,
) -> DataFrame:
    """(check_no, order_id, copies): how often each check flags each id.

    ``discounts`` is the discount column of the same orders, for a source that can give it
    with less work; the functions below take it too.
    """
    discounts = orders.select("discount_pct") if discounts is None else discounts
    row_rules = _row_rules(orders, years, discounts)
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in row_rules.items()]))
    marked = _with_masters(orders, customers, products).select(
        "order_id", F.explode(flags).alias("check_no")
    )
    by_row = marked.groupBy("check_no", "order_id").agg(F.count("*").alias("copies"))
    per_id = _copies_per_id(orders)
    both = F.array(
        F.struct(F.lit(2).alias("check_no"), F.col("id_copies").alias("copies")),
        F.struct(F.lit(3).alias("check_no"), F.col("row_copies").alias("copies")),
    )
    repeated = per_id.select("order_id", F.inline(both))
    return by_row.unionByName(repeated.filter(F.col("copies") > 0))


def violations(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    years: tuple[int, int],
    discounts: DataFrame | None = None,
) -> DataFrame:
    """Long form, whole: one row per check and flagged occurrence."""
    discounts = orders.select("discount_pct") if discounts is None else discounts
    counts = violation_counts(orders, customers, products, years, discounts)
    names = check_names(discounts, years)
    return (
        repeat_rows(counts, "copies", "_copy")
        .join(F.broadcast(names), "check_no")  # twelve rows
        .select("check_name", "order_id")
    )


def summary(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    years: tuple[int, int],
    discounts: DataFrame | None = None,
) -> DataFrame:
    """The log: one row per check with the number of rows it flags, at every size."""
    discounts = orders.select("discount_pct") if discounts is None else discounts
    counts = violation_counts(orders, customers, products, years, discounts)
    totals = counts.groupBy("check_no").agg(F.sum("copies").alias("rows_affected"))
    return (
        check_names(discounts, years)
        .join(totals, "check_no", "left")  # twelve rows on either side
        .select("check_no", "check_name", F.coalesce("rows_affected", F.lit(0)).alias("rows_affected"))
        .orderBy("check_no")
    )


def id_pages(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    years: tuple[int, int],
    discounts: DataFrame | None = None,
    ids_per_page: int = 1000,
) -> DataFrame:
    """The flagged ids of every check joined by ``, ``, whole, in pages of ``ids_per_page``
    ids, so that no row grows with the data. A missing id reads ``nan``."""
    discounts = orders.select("discount_pct") if discounts is None else discounts
    counts = violation_counts(orders, customers, products, years, discounts).withColumn(
        "order_id", F.coalesce("order_id", F.lit("nan"))
    )
    single = repeat_rows(counts, "copies", "_copy").withColumn("_one", F.lit(1).cast("bigint"))
    order = [F.col("order_id").asc(), F.col("_copy").asc()]
    placed = running_before(single, order, {"_place": "_one"}, ["check_no"])
    page = (F.floor(F.col("_place") / ids_per_page) + 1).cast("bigint")
    pages = placed.groupBy("check_no", page.alias("page")).agg(
        F.array_join(F.sort_array(F.collect_list("order_id")), ", ").alias("order_ids")
    )
    names = F.broadcast(check_names(discounts, years))  # twelve rows
    return pages.join(names, "check_no").select("check_no", "check_name", "page", "order_ids")


def affected_rows(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    years: tuple[int, int],
    discounts: DataFrame | None = None,
) -> DataFrame:
    """The full rows of every flagged order id.

    A row whose id occurs once is affected only by its own faults; every row of a repeated id
    is. So the rows meet the masters and the few repeated ids, and none is shuffled by its id.
    """
    discounts = orders.select("discount_pct") if discounts is None else discounts
    broken = reduce(lambda a, b: a | b, _row_rules(orders, years, discounts).values())
    ids = duplicate_ids(orders.select("order_id")).select(F.col("order_id").alias("_id"), F.lit(True).alias("_again"))
    rows = _with_masters(orders, customers, products)
    found = rows.join(small_side(ids), F.col("order_id").eqNullSafe(F.col("_id")), "left")
    return found.filter(broken | F.col("_again").isNotNull()).select(*orders.columns)
