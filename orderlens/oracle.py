"""The SQL each query must equal, written for DuckDB over the supplied tables.

The statements share common table expressions: ``raw`` (orders with their planted faults),
``cust`` and ``prod`` (masters), ``facts`` (cleaned lines with derived columns) and ``wide``
(facts with master attributes). Sums run on decimals, ratios on doubles.
"""

from __future__ import annotations

from orderlens.catalog import SLICE
from orderlens.schema import ORDERS_RAW

# Labels, columns and domains of its own, so that a wrong one in the code can't pass on both sides.
EXPECTED_YEARS = (1995, 2000)
MONEY_COLUMNS = ("unit_cost", "selling_price", "gross_sales", "discount_amount", "net_sales", "cost", "profit")
CLEAN_COLUMNS = (
    "order_id", "order_date", "year_month", "order_month_num", "order_month", "quarter",
    "customer_id", "customer_name", "city", "customer_type",
    "product_id", "product_name", "category", "salesperson", "payment_status",
    "quantity", "unit_cost", "selling_price", "discount_pct", "discount_band",
    "gross_sales", "discount_amount", "net_sales", "cost", "profit", "profit_margin_pct",
    "is_loss", "unknown_customer", "discount_outlier",
)
STATUSES = ("Paid", "Pending", "Overdue")
BANDS = ("0%", "1-5%", "6-10%", ">10%")
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
LOG_STEPS = (
    "Standardised payment_status / salesperson text",
    "Removed orders with unknown product_id (missing financials)",
    "Removed orders with quantity <= 0",
)
KPI_NAMES = (
    "Total orders",
    "Units sold",
    "Gross sales (₹)",
    "Discount given (₹)",
    "Net sales (₹)",
    "Total cost (₹)",
    "Profit (₹)",
    "Profit margin (%)",
    "Avg order value (₹)",
    "Active customers",
    "Loss-making orders",
)

BASE = """
WITH lines AS (
  SELECT l.*, o_orderdate, o_custkey, o_orderstatus, s_name, p_partkey,
         CASE WHEN l_orderkey % 89 <> 56 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS price,
         CASE WHEN l_orderkey % 83 = 11 THEN -3 ELSE CAST(l_quantity AS INTEGER) END AS qty,
         CAST(CASE WHEN l_orderkey % 79 = 26 THEN 35 ELSE round(l_discount * 200) END
              AS DECIMAL(6,2)) AS pct
  FROM lineitem l
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN supplier ON s_suppkey = l_suppkey
), priced AS (
  SELECT *, CAST(price AS DECIMAL(18,4)) AS sell,
         CAST(price * CAST(70 + p_partkey % 20 AS DECIMAL(3,0)) * 0.01 AS DECIMAL(18,4)) AS unit,
         CAST(qty * price + CASE WHEN l_orderkey % 71 = 9 THEN 0.02 ELSE 0.00 END AS DECIMAL(18,4)) AS gross
  FROM lines
), costed AS (
  SELECT *, CAST(gross * pct * 0.01 AS DECIMAL(18,4)) AS disc,
         CAST(qty * unit + CASE WHEN l_orderkey % 59 = 18 THEN 0.02 ELSE 0.00 END AS DECIMAL(18,4)) AS spent
  FROM priced
), net AS (
  SELECT *, CAST(gross - disc + CASE WHEN l_orderkey % 67 = 5 THEN 0.02 ELSE 0.00 END AS DECIMAL(18,4)) AS sold
  FROM costed
), raw AS (
  SELECT 'O' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(l_quantity AS BIGINT) AS order_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN l_orderkey % 97 = 41 THEN 'C999X' ELSE 'C' || o_custkey END AS customer_id,
         CASE WHEN l_orderkey % 89 = 56 THEN 'P999X' ELSE 'P' || l_partkey END AS product_id,
         qty AS quantity, pct AS discount_pct,
         CASE WHEN l_orderkey % 73 = 7 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'Paid'
              WHEN o_orderstatus = 'O' THEN 'Pending' WHEN o_orderstatus = 'P' THEN 'Overdue'
         END AS payment_status,
         s_name AS salesperson, unit AS unit_cost, sell AS selling_price, gross AS gross_sales,
         disc AS discount_amount, sold AS net_sales, spent AS cost,
         CAST(sold - spent + CASE WHEN l_orderkey % 61 = 33 THEN 0.02 ELSE 0.00 END AS DECIMAL(18,4)) AS profit
  FROM net
), cust AS (
  SELECT 'C' || c_custkey AS customer_id, c_name AS customer_name, n_name AS city,
         c_mktsegment AS customer_type
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
), prod AS (
  SELECT 'P' || p_partkey AS product_id, concat_ws(' ', p_name, p_partkey) AS product_name,
         p_type AS category
  FROM part
), facts AS (
  SELECT order_id, order_date, customer_id, product_id, quantity, discount_pct,
         upper(left(trim(payment_status), 1)) || lower(substr(trim(payment_status), 2))
           AS payment_status,
         upper(left(trim(salesperson), 1)) || lower(substr(trim(salesperson), 2)) AS salesperson,
         {money},
         strftime(order_date, '%Y-%m') AS year_month, month(order_date) AS order_month_num,
         strftime(order_date, '%b') AS order_month, 'Q' || quarter(order_date) AS quarter,
         round_even(CAST(profit AS DOUBLE) / nullif(CAST(net_sales AS DOUBLE), 0) * 100 * 100, 0)
           / 100 AS profit_margin_pct,
         coalesce(profit < 0, false) AS is_loss,
         CASE WHEN discount_pct <= -1 THEN NULL WHEN discount_pct <= 0 THEN '0%'
              WHEN discount_pct <= 5 THEN '1-5%' WHEN discount_pct <= 10 THEN '6-10%'
              WHEN discount_pct <= 100 THEN '>10%' END AS discount_band,
         coalesce(discount_pct > 20, false) AS discount_outlier
  FROM raw
  WHERE (quantity > 0 OR quantity IS NULL) AND product_id IN (SELECT product_id FROM prod)
), wide AS (
  SELECT f.*, coalesce(c.customer_name, 'Unknown') AS customer_name,
         coalesce(c.city, 'Unknown') AS city, coalesce(c.customer_type, 'Unknown') AS customer_type,
         c.customer_id IS NULL AS unknown_customer, p.product_name, p.category
  FROM facts f LEFT JOIN cust c USING (customer_id) LEFT JOIN prod p USING (product_id)
)"""


def num(expression: str, name: str = "") -> str:
    """An expression as DOUBLE."""
    return f"CAST({expression} AS DOUBLE)" + (f" AS {name}" if name else "")


def whole(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def ratio2(part: str, all_: str) -> str:
    """Hundredths of part / all_ in whole numbers, half away from zero. Both have at most two
    decimals."""
    top, bottom = (f"CAST(({x}) * 100 AS HUGEINT)" for x in (part, all_))
    cents = f"(abs({top}) * 200 + abs({bottom})) // nullif(abs({bottom}) * 2, 0)"
    return f"CAST(sign({top}) * sign({bottom}) * ({cents}) AS DOUBLE) / 100"


def pct2(part: str, all_: str) -> str:
    return ratio2(f"({part}) * 100", all_)


def pct(part: str, all_: str) -> str:
    return f"{num(part)} / nullif({num(all_)}, 0) * 100"


def avg2(total: str) -> str:
    return ratio2(f"sum({total})", f"count({total})")


def even2(value: str) -> str:
    """A decimal to two digits, halves to the even one."""
    tie = f"abs({value}) * 100 % 1 = 0.5 AND round(abs({value}) * 100, 0) % 2 = 1"
    return f"CAST(round({value}, 2) - CASE WHEN {tie} THEN sign({value}) * 0.01 ELSE 0 END AS DECIMAL(18,2))"


def avg(total: str) -> str:
    return f"{num(f'sum({total})')} / nullif(count({total}), 0)"


def with_base(select: str, *more: str) -> str:
    money = ",\n         ".join(f"{even2(c)} AS {c}" for c in MONEY_COLUMNS)
    return BASE.replace("{money}", money) + "".join(f", {m}" for m in more) + "\n" + select


def ids(where: str) -> str:
    return with_base(f"SELECT order_id FROM raw WHERE {where}")


MONEY2 = "CAST(sum(net_sales) AS DOUBLE) AS net_sales, CAST(sum(profit) AS DOUBLE) AS profit"
MARGIN2 = f"{pct2('sum(profit)', 'sum(net_sales)')} AS margin_pct"
MARGIN = f"{pct('sum(profit)', 'sum(net_sales)')} AS margin_pct"
KPIS = f"""count(*) AS total_orders, {whole('sum(quantity)', 'units_sold')},
  {num('sum(gross_sales)', 'gross_sales')}, {num('sum(discount_amount)', 'total_discount')},
  {MONEY2}, {pct2('sum(profit)', 'sum(net_sales)')} AS profit_margin_pct,
  {avg2('net_sales')} AS avg_order_value"""
FENCE = """fence AS (SELECT q3 + 1.5 * (q3 - q1) AS top FROM (
  SELECT quantile_cont(CAST(discount_pct AS DOUBLE), 0.25) AS q1,
         quantile_cont(CAST(discount_pct AS DOUBLE), 0.75) AS q3 FROM raw))"""
RAW_COLUMNS = ORDERS_RAW.names
RAW_SELECT = ", ".join(
    num(c, c) if c in (*MONEY_COLUMNS, "discount_pct") else whole(c, c) if c == "quantity" else c
    for c in RAW_COLUMNS
)
WIDE_SELECT = ", ".join(
    num(c, c)
    if c in (*MONEY_COLUMNS, "discount_pct")
    else whole(c, c)
    if c in ("quantity", "order_month_num")
    else c
    for c in CLEAN_COLUMNS
)
ANY_MISSING = " OR ".join(f"{c} IS NULL" for c in RAW_COLUMNS)
IN_STATUSES = "(" + ", ".join(f"'{s}'" for s in STATUSES) + ")"
BAD_STATUS = f"payment_status IS NULL OR payment_status NOT IN {IN_STATUSES}"
OFF_YEAR = (
    f"order_date IS NULL OR year(order_date) < {EXPECTED_YEARS[0]}"
    f" OR year(order_date) > {EXPECTED_YEARS[1]}"
)
OFF_GROSS = "abs(quantity * selling_price - gross_sales) > 0.01"
OFF_NET = "abs(gross_sales - discount_amount - net_sales) > 0.01"
OFF_PROFIT = "abs(net_sales - cost - profit) > 0.01"
NO_CUSTOMER = "customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM cust)"
NO_PRODUCT = "product_id IS NULL OR product_id NOT IN (SELECT product_id FROM prod)"


def delivered(statement: str) -> str:
    """The same statement on the lines as they come in: some orders twice, of these some with a
    discount that is one percent higher the second time."""
    sent = """WITH sent AS (
  SELECT *, 0 AS again FROM lineitem
  UNION ALL SELECT *, 1 FROM lineitem WHERE l_orderkey % 107 = 20
  UNION ALL SELECT *, 0 FROM lineitem WHERE l_orderkey % 103 = 12 AND l_orderkey % 107 <> 20
), lines AS ("""
    percent = "round(l_discount * 200) END"
    for old in ("WITH lines AS (", "FROM lineitem l\n", percent):
        if statement.count(old) != 1:
            raise ValueError("unexpected statement")
    statement = statement.replace("FROM lineitem l\n", "FROM sent l\n")
    statement = statement.replace(percent, "round(l_discount * 200) + again END")
    return statement.replace("WITH lines AS (", sent)


def _violations() -> str:
    """The CTE ``hits`` (check_no, check_name, order_id), with the CTE ``names``."""
    span = f"{EXPECTED_YEARS[0]}-{EXPECTED_YEARS[1]}"
    values = ",\n  ".join(
        f"({n}, '{t.replace('{years}', span)}')" for n, t in enumerate(CHECKS, 1)
    )
    rules = {
        1: ANY_MISSING,
        4: BAD_STATUS,
        5: "quantity <= 0",
        6: "discount_pct > (SELECT top FROM fence)",
        7: NO_CUSTOMER,
        8: NO_PRODUCT,
        9: OFF_GROSS,
        10: OFF_NET,
        11: OFF_PROFIT,
        12: OFF_YEAR,
    }
    parts = [f"SELECT {n} AS check_no, order_id FROM raw WHERE {rule}" for n, rule in rules.items()]
    parts.append(
        "SELECT 2, order_id FROM raw"
        " QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY order_date) > 1"
    )
    parts.append(
        f"SELECT 3, order_id FROM raw"
        f" QUALIFY row_number() OVER (PARTITION BY {', '.join(RAW_COLUMNS)} ORDER BY order_date) > 1"
    )
    union = "\n  UNION ALL ".join(parts)
    return f"""{FENCE}, names AS (
  SELECT n AS check_no, replace(t, '{{fence}}', format('{{:.0f}}', (SELECT top FROM fence)))
    AS check_name
  FROM (VALUES {values}) v(n, t)
), hits AS (
  {union}
)"""


def _sources() -> dict[str, str]:
    counts = [
        with_base(
            f"SELECT {column} AS value, count(*) AS n FROM {table}"
            f" WHERE {column} IS NOT NULL GROUP BY {column}"
        )
        for table, column in (
            ("raw", "payment_status"),
            ("raw", "salesperson"),
            ("cust", "customer_type"),
            ("cust", "city"),
            ("prod", "category"),
        )
    ]
    types = {f.name: f.dataType.simpleString() for f in ORDERS_RAW}
    nulls = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM raw"
        for c, t in types.items()
    )
    day = "order_date - DATE '1970-01-01'"
    numeric = ["order_date", "quantity", "discount_pct", *MONEY_COLUMNS]
    described = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({v}) AS "count",
          CAST(sum({v}) AS DOUBLE) / count({v}) AS mean,
          {'CAST(NULL AS DOUBLE)' if c == 'order_date' else f'round(stddev_samp({num(v)}), 4)'} AS std,
          {num(f'min({v})', '"min"')}, quantile_cont({num(v)}, 0.25) AS q1,
          quantile_cont({num(v)}, 0.5) AS median, quantile_cont({num(v)}, 0.75) AS q3,
          {num(f'max({v})', '"max"')} FROM raw"""
        for c, v in ((c, day if c == "order_date" else c) for c in numeric)
    )
    return {
        "shape_report": with_base(
            """SELECT 'Orders' AS name, count(*) AS "rows", CAST(15 AS BIGINT) AS cols FROM raw
            UNION ALL SELECT 'Customers', count(*), 5 FROM cust
            UNION ALL SELECT 'Products', count(*), 3 FROM prod"""
        ),
        "preview": with_base(f"SELECT {RAW_SELECT} FROM raw ORDER BY order_id LIMIT 5"),
        "preview_clean": with_base(f"SELECT {WIDE_SELECT} FROM wide ORDER BY order_id LIMIT 5"),
        "preview_customers": _customers("ORDER BY net_sales DESC, customer_id LIMIT 10"),
        "profile_nulls": with_base(nulls),
        "describe_numeric": with_base(described),
        "value_counts_payment_status": counts[0],
        "value_counts_salesperson": counts[1],
        "value_counts_customer_type": counts[2],
        "value_counts_city": counts[3],
        "value_counts_category": counts[4],
        "date_range": with_base(
            "SELECT min(order_date) AS first_date, max(order_date) AS last_date FROM raw"
        ),
    }


def _quality() -> dict[str, str]:
    everything = ", ".join(RAW_COLUMNS)
    later = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY order_id) > 1"
    return {
        "dq_missing": ids(ANY_MISSING),
        "dq_dup_id": with_base("SELECT order_id FROM raw " + later.format("order_id")),
        "dq_dup_row": with_base("SELECT order_id FROM raw " + later.format(everything)),
        "dq_bad_status": ids(BAD_STATUS),
        "dq_qty": ids("quantity <= 0"),
        "dq_iqr_outlier": with_base(
            "SELECT order_id, top AS fence FROM raw, fence WHERE discount_pct > top", FENCE
        ),
        "dq_orphan_customer": ids(NO_CUSTOMER),
        "dq_orphan_product": ids(NO_PRODUCT),
        "dq_gross": ids(OFF_GROSS),
        "dq_net": ids(OFF_NET),
        "dq_profit": ids(OFF_PROFIT),
        "dq_cost": ids("abs(quantity * unit_cost - cost) > 0.01"),
        "dq_date_range": ids(OFF_YEAR),
        "dq_violations": with_base(
            "SELECT check_name, order_id FROM hits JOIN names USING (check_no)", _violations()
        ),
        "dq_summary": with_base(
            """SELECT CAST(check_no AS BIGINT) AS check_no, check_name, count(order_id) AS rows_affected
            FROM names LEFT JOIN hits USING (check_no) GROUP BY check_no, check_name""",
            _violations(),
        ),
        "dq_id_pages": with_base(
            """SELECT CAST(check_no AS BIGINT) AS check_no, check_name, page,
              string_agg(order_id, ', ' ORDER BY order_id) AS order_ids
            FROM (SELECT check_no, order_id,
                    (row_number() OVER (PARTITION BY check_no ORDER BY order_id) - 1) // 1000 + 1 AS page
                  FROM hits) JOIN names USING (check_no)
            GROUP BY check_no, check_name, page""",
            _violations(),
        ),
        "dq_affected_rows": with_base(
            f"SELECT {RAW_SELECT} FROM raw WHERE order_id IN (SELECT order_id FROM hits)",
            _violations(),
        ),
        "dq_row_counts": with_base(
            "SELECT 'orders' AS table_name, count(*) AS row_count FROM facts"
            " UNION ALL SELECT 'orders_raw', count(*) FROM raw"
        ),
        "dq_orphans": with_base(
            """SELECT * FROM (
              SELECT order_id, customer_id, product_id,
                CASE WHEN customer_id NOT IN (SELECT customer_id FROM cust)
                     THEN 'Missing customer' END AS customer_issue,
                CASE WHEN product_id NOT IN (SELECT product_id FROM prod)
                     THEN 'Missing product' END AS product_issue
              FROM raw)
            WHERE coalesce(customer_issue, product_issue) IS NOT NULL"""
        ),
        "dq_invalid_values": with_base(
            f"""SELECT order_id, {whole('quantity', 'quantity')}, {num('discount_pct', 'discount_pct')},
              {num('net_sales', 'net_sales')},
              if(net_sales IS NULL, 'Missing sales values',
                 if(quantity <= 0, 'Invalid quantity', 'Discount outlier')) AS issue
            FROM raw WHERE net_sales IS NULL OR quantity <= 0 OR discount_pct > 20"""
        ),
        "dq_status_spelling": with_base(
            "SELECT payment_status, count(*) AS orders FROM raw GROUP BY payment_status"
        ),
        "dq_duplicate_ids": with_base(
            "SELECT * FROM (SELECT order_id, count(*) AS cnt FROM raw GROUP BY order_id)"
            " WHERE cnt > 1"
        ),
    }


def _cleaning() -> dict[str, str]:
    def verdict(rule: str, n: str, source: str) -> str:
        return with_base(
            f"SELECT '{rule}' AS rule, n = 0 AS passed, CAST(n AS BIGINT) AS violations"
            f" FROM (SELECT {n} AS n FROM {source})"
        )

    money_missing = " OR ".join(f"{c} IS NULL" for c in MONEY_COLUMNS)
    absent = " + ".join(
        f"CASE WHEN count(*) FILTER (payment_status = '{s}') = 0 THEN 1 ELSE 0 END"
        for s in STATUSES
    )
    counts = f"""(SELECT count(*) AS all_rows, count(*) FILTER ({NO_PRODUCT}) AS orphan,
        count(*) FILTER (quantity <= 0 AND NOT ({NO_PRODUCT})) AS bad FROM raw)"""
    money = ", ".join(num(c, c) for c in MONEY_COLUMNS)
    return {
        "clean_text": with_base(
            """SELECT order_id,
              upper(payment_status[1]) || lower(payment_status[2:]) AS payment_status,
              upper(salesperson[1]) || lower(salesperson[2:]) AS salesperson FROM raw"""
        ),
        "clean_drop_orphan_product": with_base(
            f"SELECT {RAW_SELECT} FROM raw SEMI JOIN prod USING (product_id)"
        ),
        "clean_drop_bad_qty": with_base(
            f"SELECT {RAW_SELECT} FROM raw WHERE coalesce(quantity, 1) > 0"
        ),
        "flag_unknown_customer": with_base(
            "SELECT order_id, customer_id, customer_id NOT IN (SELECT customer_id FROM cust)"
            " AS unknown_customer FROM raw"
        ),
        "flag_discount_outlier": with_base(
            f"SELECT order_id, {num('discount_pct', 'discount_pct')}, discount_outlier FROM facts"
        ),
        "cleaning_log": with_base(
            f"""SELECT unnest(['{LOG_STEPS[0]}', '{LOG_STEPS[1]}', '{LOG_STEPS[2]}']) AS step,
              unnest([0, orphan, bad]) AS rows_removed FROM {counts}"""
        ),
        "enrich": with_base(
            """SELECT raw.order_id, raw.customer_id, raw.product_id,
              coalesce(customer_name, 'Unknown') AS customer_name, coalesce(city, 'Unknown') AS city,
              coalesce(customer_type, 'Unknown') AS customer_type,
              cust.customer_id IS NULL AS unknown_customer, product_name, category
            FROM raw LEFT JOIN cust ON cust.customer_id = raw.customer_id
            LEFT JOIN prod ON prod.product_id = raw.product_id"""
        ),
        "derived_columns": with_base(
            f"""SELECT order_id, year_month, {whole('order_month_num', 'order_month_num')},
              order_month, quarter, profit_margin_pct, is_loss, discount_band FROM facts"""
        ),
        "rounded_money": with_base(f"SELECT order_id, {money} FROM facts"),
        "clean": with_base(f"SELECT {WIDE_SELECT} FROM wide"),
        "validate_unique": verdict(
            "order_id is unique",
            "count(*) FILTER (c > 1)",
            "(SELECT order_id, count(*) AS c FROM wide GROUP BY order_id)",
        ),
        "validate_money": verdict(
            "no missing money", f"count(*) FILTER ({money_missing})", "wide"
        ),
        "validate_qty": verdict(
            "quantity is positive", "count(*) - count(*) FILTER (quantity > 0)", "wide"
        ),
        "validate_status": verdict(
            "payment_status is Paid, Pending, Overdue",
            f"count(*) FILTER ({BAD_STATUS}) + {absent}",
            "wide",
        ),
        "validate_product_fk": verdict(
            "product_id is known", f"count(*) FILTER ({NO_PRODUCT})", "facts"
        ),
        "validate_summary": with_base(
            f"""SELECT all_rows AS raw_rows, all_rows - orphan - bad AS clean_rows,
              orphan + bad AS removed_rows FROM {counts}"""
        ),
    }


def _sql_reports() -> dict[str, str]:
    return {
        "kpi_headline": with_base(f"SELECT {KPIS} FROM facts"),
        "monthly_trend": with_base(
            f"""SELECT year_month, n AS orders, {num('net', 'net_sales')}, {num('gain', 'profit')},
              {pct2('net - before', 'before')} AS mom_growth_pct
            FROM (SELECT *, lag(net) OVER (ORDER BY year_month NULLS FIRST) AS before
                  FROM (SELECT year_month, count(*) AS n, sum(net_sales) AS net,
                               sum(profit) AS gain FROM facts GROUP BY 1))"""
        ),
        "quarterly": with_base(
            f"SELECT quarter, count(*) AS orders, {MONEY2}, {MARGIN2} FROM facts GROUP BY 1"
        ),
        "category_perf": with_base(
            f"""SELECT category, count(*) AS orders, {whole('sum(quantity)', 'units')}, {MONEY2},
              {MARGIN2}, {pct2('sum(net_sales)', 'any_value(everything)')} AS sales_share_pct
            FROM facts JOIN prod USING (product_id),
                 (SELECT sum(net_sales) AS everything FROM facts)
            GROUP BY category"""
        ),
        "top_products": with_base(
            f"""SELECT product_id, product_name, category, {whole('sum(quantity)', 'units')}, {MONEY2}
            FROM wide GROUP BY ALL ORDER BY sum(net_sales) DESC, product_id LIMIT 5"""
        ),
        "bottom_margin_products": with_base(
            f"""SELECT product_id, product_name, category, {num('sum(net_sales)', 'net_sales')},
              {MARGIN2} FROM wide GROUP BY ALL
            ORDER BY margin_pct NULLS FIRST, product_id LIMIT 5"""
        ),
        "best_product_per_category": with_base(
            """SELECT category, product_name, CAST(net AS DOUBLE) AS net_sales
            FROM (SELECT category, product_name, sum(net_sales) AS net FROM wide GROUP BY ALL)
            QUALIFY net = max(net) OVER (PARTITION BY category)"""
        ),
        "city_sales": with_base(
            f"""SELECT city, count(DISTINCT customer_id) AS customers, count(*) AS orders, {MONEY2}
            FROM wide GROUP BY city"""
        ),
        "customer_type_sales": with_base(
            f"""SELECT customer_type, count(DISTINCT customer_id) AS customers, count(*) AS orders,
              {num('sum(net_sales)', 'net_sales')}, {avg2('wide.net_sales')} AS avg_order_value,
              {MARGIN2} FROM wide GROUP BY customer_type"""
        ),
        "top_customers": with_base(
            f"""SELECT c.customer_id, c.customer_name, c.city, c.customer_type, count(*) AS orders,
              {MONEY2} FROM cust c JOIN facts f ON f.customer_id = c.customer_id GROUP BY ALL
            ORDER BY sum(net_sales) DESC, c.customer_id LIMIT 10"""
        ),
        "salesperson_rank": with_base(
            f"""SELECT salesperson, count(*) AS orders, {MONEY2}, {MARGIN2},
              {avg2('discount_pct')} AS avg_discount_pct,
              count(*) FILTER (payment_status = 'Overdue') AS overdue_orders,
              rank() OVER (ORDER BY sum(facts.net_sales) DESC) AS sales_rank
            FROM facts GROUP BY salesperson"""
        ),
        "payment_status_summary": with_base(
            f"""SELECT payment_status, count(*) AS orders, {num('sum(net_sales)', 'net_sales')},
              {pct2('sum(facts.net_sales)', 'sum(sum(facts.net_sales)) OVER ()')} AS share_pct
            FROM facts GROUP BY payment_status"""
        ),
        "top_overdue_customers": _overdue("facts.customer_id IS NULL OR true"),
        "discount_band_margin": with_base(
            f"""SELECT band AS discount_band, count(*) AS orders,
              {num('sum(net_sales)', 'net_sales')}, {MARGIN2},
              count(*) FILTER (profit < 0) AS loss_orders
            FROM (SELECT *, if(discount_pct = 0, '1) 0%', if(discount_pct <= 5, '2) 1-5%',
                    if(discount_pct <= 10, '3) 6-10%', '4) >10%'))) AS band FROM facts)
            GROUP BY band"""
        ),
        "loss_orders": with_base(
            f"""SELECT order_id, order_date, product_name, category, salesperson,
              {num('discount_pct', 'discount_pct')}, {num('net_sales', 'net_sales')},
              {num('profit', 'profit')} FROM wide WHERE profit < 0"""
        ),
    }


def _overdue(where: str) -> str:
    return with_base(
        f"""SELECT facts.customer_id, coalesce(customer_name, 'Unknown') AS customer_name,
          coalesce(city, 'Unknown') AS city, count(*) AS overdue_orders,
          {num('sum(net_sales)', 'overdue_amount')}
        FROM facts LEFT JOIN cust ON cust.customer_id = facts.customer_id
        WHERE payment_status = 'Overdue' AND ({where}) GROUP BY ALL
        ORDER BY sum(net_sales) DESC, facts.customer_id LIMIT 10"""
    )


def _customers(end: str = "") -> str:
    return with_base(
        f"""SELECT customer_id, customer_name, city, customer_type, n AS orders,
          {num('net', 'net_sales')}, {num('gain', 'profit')},
          {pct('sum(net) OVER (ORDER BY net DESC, customer_id ROWS UNBOUNDED PRECEDING)',
               'sum(net) OVER ()')} AS cum_share_pct
        FROM (SELECT customer_id, customer_name, city, customer_type, count(order_id) AS n,
                sum(net_sales) AS net, sum(profit) AS gain
              FROM wide WHERE customer_id IS NOT NULL GROUP BY ALL) {end}"""
    )


def _kpi_rows() -> str:
    values = (
        "count(*)",
        "sum(quantity)",
        "sum(gross_sales)",
        "sum(discount_amount)",
        "sum(net_sales)",
        "sum(cost)",
        "sum(profit)",
        pct("sum(profit)", "sum(net_sales)"),
        avg("net_sales"),
        "count(DISTINCT customer_id)",
        "count(*) FILTER (is_loss)",
    )
    return with_base(
        "\nUNION ALL ".join(
            f"SELECT '{n}' AS metric, {num(v, 'value')} FROM facts"
            for n, v in zip(KPI_NAMES, values)
        )
    )


def _domain(values: tuple[str, ...], key: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {key})"


def _products(end: str) -> str:
    return with_base(
        f"""SELECT product_id, product_name, category, {whole('sum(quantity)', 'units')}, {MONEY2},
          {MARGIN} FROM wide WHERE product_name IS NOT NULL AND category IS NOT NULL
        GROUP BY ALL ORDER BY {end}"""
    )


MONTHS = f"""months AS (SELECT order_month_num, order_month, count(order_id) AS orders, {MONEY2},
  {MARGIN} FROM facts WHERE order_date IS NOT NULL GROUP BY ALL)"""
BANDED = f"""banded AS (SELECT discount_band, count(order_id) AS orders, {MONEY2},
  count(*) FILTER (is_loss) AS loss_orders, {MARGIN} FROM facts GROUP BY discount_band)"""
STATUS_SHARES = f"""shares AS (SELECT payment_status, orders, {num('net', 'net_sales')},
    {pct('net', 'sum(net) OVER ()')} AS share_pct
  FROM {_domain(STATUSES, 'payment_status')} LEFT JOIN (
    SELECT payment_status, count(order_id) AS orders, sum(net_sales) AS net
    FROM facts GROUP BY payment_status) USING (payment_status))"""
CATEGORIES = f"""categories AS (SELECT category, count(order_id) AS orders,
    {whole('sum(quantity)', 'units')}, {MONEY2}, {MARGIN},
    {pct('sum(wide.net_sales)', 'sum(sum(wide.net_sales)) OVER ()')} AS sales_share_pct
  FROM wide WHERE category IS NOT NULL GROUP BY category)"""


def _group(key: str, more: str = "") -> str:
    return f"""SELECT {key}, count(DISTINCT customer_id) AS customers, count(order_id) AS orders,
      {MONEY2}, {MARGIN} {more} FROM wide GROUP BY {key}"""


def _frame_reports() -> dict[str, str]:
    return {
        "kpi_full": _kpi_rows(),
        "monthly_by_month_num": with_base(
            """SELECT * REPLACE (CAST(order_month_num AS BIGINT) AS order_month_num),
              (net_sales / nullif(lag(net_sales) OVER (ORDER BY order_month_num), 0) - 1) * 100
                AS mom_growth_pct
            FROM months""",
            MONTHS,
        ),
        "category_perf_df": with_base("SELECT * FROM categories", CATEGORIES),
        "top10_products": _products("sum(net_sales) DESC, product_id LIMIT 10"),
        "bottom5_margin_df": _products("margin_pct NULLS LAST, product_id LIMIT 5"),
        "city_perf": with_base(_group("city")),
        "customer_type_perf": with_base(
            _group("customer_type", f", {avg('wide.net_sales')} AS avg_order_value")
        ),
        "customer_perf": _customers(),
        "pareto_top20": with_base(
            f"""SELECT place AS top_customers, {pct('upto', 'everything')} AS cum_share_pct
            FROM (SELECT row_number() OVER w AS place, sum(net) OVER w AS upto,
                    sum(net) OVER () AS everything, count(*) OVER () AS n
                  FROM (SELECT customer_id, sum(net_sales) AS net FROM facts
                        WHERE customer_id IS NOT NULL GROUP BY customer_id)
                  WINDOW w AS (ORDER BY net DESC, customer_id ROWS UNBOUNDED PRECEDING))
            WHERE place = ceil(n * CAST(0.2 AS DOUBLE))"""
        ),
        "salesperson_perf": with_base(
            f"""SELECT salesperson, count(order_id) AS orders, {MONEY2},
              {avg('discount_pct')} AS avg_discount_pct, count(*) FILTER (is_loss) AS loss_orders,
              count(*) FILTER (payment_status = 'Overdue') AS overdue_orders, {MARGIN}
            FROM facts WHERE salesperson IS NOT NULL GROUP BY salesperson"""
        ),
        "payment_status_domain": with_base("SELECT * FROM shares", STATUS_SHARES),
        "overdue_customers_df": _overdue("facts.customer_id IS NOT NULL"),
        "discount_band_df": with_base(
            f"SELECT * FROM {_domain(BANDS, 'discount_band')} LEFT JOIN banded USING (discount_band)",
            BANDED,
        ),
        "discount_margin_corr": with_base(
            "SELECT round(corr(CAST(discount_pct AS DOUBLE), profit_margin_pct), 3) AS correlation"
            " FROM facts"
        ),
        "loss_summary": with_base(
            f"""SELECT any_value(n) AS loss_orders, any_value(lost) AS total_loss,
              any_value(mean_pct) AS avg_discount_loss, {avg('discount_pct')} AS avg_discount_all
            FROM facts, (SELECT count(*) AS n, {num('-sum(profit)', 'lost')},
                           {avg('discount_pct')} AS mean_pct FROM facts WHERE is_loss)"""
        ),
        "loss_by_category": with_base(
            f"""SELECT category, count(order_id) AS orders, {num('sum(profit)', 'loss')}
            FROM wide WHERE is_loss AND category IS NOT NULL GROUP BY category"""
        ),
        "quarterly_df": with_base(
            f"""SELECT quarter, count(order_id) AS orders, {MONEY2}, {MARGIN} FROM facts
            WHERE quarter IS NOT NULL GROUP BY quarter"""
        ),
    }


def _findings() -> dict[str, str]:
    open_ = "sum(net_sales) FILTER (payment_status IN ('Pending', 'Overdue'))"
    late = "sum(net_sales) FILTER (payment_status = 'Overdue')"
    person = f"""people AS (SELECT salesperson, sum(net_sales) AS net,
        count(*) FILTER (payment_status = 'Overdue') AS late, {MARGIN}
      FROM facts WHERE salesperson IS NOT NULL GROUP BY salesperson)"""

    def leader(table: str, key: str, value: str, order: str, text: str) -> str:
        return (
            f"(SELECT '{text}' AS finding, {key} AS name, {num(value, 'value')}"
            f" FROM {table} ORDER BY {order}, {key} LIMIT 1)"
        )

    everything = "(SELECT sum(net_sales) FROM facts)"
    rows = [
        leader("people", "salesperson", "net", "net DESC", "Top salesperson by sales"),
        leader(
            "people",
            "salesperson",
            pct("net", everything),
            "net DESC",
            "Top salesperson, share of sales (%)",
        ),
        leader("people", "salesperson", "late", "late DESC", "Most overdue orders"),
        leader("people", "salesperson", "margin_pct", "margin_pct", "Lowest margin (%)"),
    ]
    for key, text in (("city", "Top city"), ("customer_type", "Top customer type")):
        table = f"(SELECT {key}, sum(net_sales) AS net FROM wide GROUP BY {key})"
        rows.append(leader(table, key, "net", "net DESC", f"{text} by sales"))
        rows.append(
            leader(table, key, pct("net", everything), "net DESC", f"{text}, share of sales (%)")
        )
    by_month = "months AS (SELECT year_month, sum(net_sales) AS net FROM facts GROUP BY 1)"
    return {
        "receivables": with_base(
            f"""SELECT {num(open_, 'uncollected_amount')},
              {pct(open_, 'sum(net_sales)')} AS uncollected_share_pct,
              {num("sum(net_sales) FILTER (payment_status = 'Pending')", 'pending_amount')},
              {num(late, 'overdue_amount')},
              count(*) FILTER (payment_status = 'Overdue') AS overdue_orders FROM facts"""
        ),
        "discount_share_of_gross": with_base(
            f"""SELECT {num('sum(gross_sales)', 'gross_sales')},
              {num('sum(discount_amount)', 'discount_amount')},
              {pct('sum(discount_amount)', 'sum(gross_sales)')} AS discount_share_pct FROM facts"""
        ),
        "best_worst_month": with_base(
            f"""SELECT b.year_month AS best_month, {num('b.net', 'best_net_sales')},
              w.year_month AS worst_month, {num('w.net', 'worst_net_sales')},
              {pct('w.net - w.before', 'w.before')} AS worst_change_pct
            FROM (SELECT * FROM months ORDER BY net DESC, year_month DESC LIMIT 1) b,
                 (SELECT *, lag(net) OVER (ORDER BY year_month) AS before FROM months
                  ORDER BY net, year_month LIMIT 1) w""",
            by_month,
        ),
        "hidden_problem_products": with_base(
            f"""SELECT * FROM (SELECT product_id, product_name, category,
                {num('sum(net_sales)', 'net_sales')},
                rank() OVER (ORDER BY sum(wide.net_sales) DESC) AS sales_rank, {MARGIN}
              FROM wide GROUP BY product_id, product_name, category)
            WHERE sales_rank <= 10 AND margin_pct < 15"""
        ),
        "loss_vs_threshold": with_base(
            f"""SELECT count(*) AS loss_orders,
              count(*) FILTER (discount_pct > 10) AS loss_orders_above_threshold,
              {pct('count(*) FILTER (discount_pct > 10)', 'count(*)')} AS share_above_pct,
              {avg('discount_pct')} AS avg_discount_loss FROM facts WHERE is_loss"""
        ),
        "largest_loss_order": with_base(
            f"""SELECT order_id, {num('discount_pct', 'discount_pct')},
              {num('net_sales', 'net_sales')}, {num('profit', 'profit')}
            FROM facts WHERE profit < 0 ORDER BY facts.profit, order_id LIMIT 1"""
        ),
        "overdue_concentration": with_base(
            f"""SELECT {num('sum(net) FILTER (place <= 10)', 'top_overdue_amount')},
              {num('sum(net)', 'overdue_amount')},
              {pct('sum(net) FILTER (place <= 10)', 'sum(net)')} AS top_share_pct
            FROM (SELECT sum(net_sales) AS net, row_number() OVER
                    (ORDER BY sum(net_sales) DESC, customer_id) AS place
                  FROM facts WHERE payment_status = 'Overdue' GROUP BY customer_id)"""
        ),
        "leaders": with_base("\nUNION ALL ".join(rows), person),
        "scope_counts": with_base(
            """SELECT count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
              count(DISTINCT product_id) AS products, count(DISTINCT salesperson) AS salespeople,
              count(DISTINCT customer_id) FILTER (NOT unknown_customer) AS known_customers,
              count(DISTINCT city) FILTER (city <> 'Unknown') AS cities FROM wide"""
        ),
        "below_avg_categories": with_base(
            f"""SELECT * FROM (SELECT category, {MARGIN},
                {pct('sum(sum(profit)) OVER ()', 'sum(sum(net_sales)) OVER ()')}
                  AS overall_margin_pct
              FROM wide GROUP BY category)
            WHERE category IS NOT NULL AND margin_pct < overall_margin_pct"""
        ),
        "slow_months": with_base(
            f"""SELECT * FROM (SELECT year_month, {num('net', 'net_sales')},
                {num('sum(net) OVER ()')} / count(net) OVER () AS average_net_sales
              FROM months WHERE year_month IS NOT NULL)
            WHERE net_sales < average_net_sales""",
            by_month,
        ),
        "dashboard_cube": with_base(
            f"""SELECT salesperson, category, grouping(salesperson) = 1 AS all_salespeople,
              grouping(category) = 1 AS all_categories, {KPIS}, {num('sum(cost)', 'total_cost')},
              count(DISTINCT customer_id) AS active_customers,
              count(*) FILTER (is_loss) AS loss_orders
            FROM wide GROUP BY CUBE (salesperson, category)"""
        ),
        "kpi_filtered": with_base(
            f"""SELECT {KPIS} FROM wide
            WHERE salesperson = '{SLICE['salesperson']}' AND category = '{SLICE['category']}'"""
        ),
    }


def _narrowed(statement: str, where: str) -> str:
    """The same statement on a part of the cleaned lines."""
    old = "WHERE (quantity > 0 OR quantity IS NULL)"
    if statement.count(old) != 1:
        raise ValueError("unexpected statement")
    return statement.replace(old, f"{old} AND {where}")


def _charts() -> dict[str, str]:
    def text(column: str, before: str = "") -> str:
        return f"'{before}' || format('{{:.1f}}', {column}) || '%'"

    return {
        "chart_monthly_trend": with_base(
            f"""SELECT {whole('order_month_num', 'order_month_num')}, order_month, net_sales, profit,
              '₹' || format('{{:,}}', CAST(floor(round(net_sales / 1e5, 1)) AS BIGINT)) || '.'
                || CAST(round(net_sales / 1e4) AS BIGINT) % 10 || 'L' AS axis_label
            FROM months""",
            MONTHS,
        ),
        "chart_category": with_base(
            f"""SELECT category, net_sales, profit, {text('margin_pct', 'margin ')} AS bar_label
            FROM categories""",
            CATEGORIES,
        ),
        "chart_top_products": with_base(
            """SELECT product_name, CAST(sum(net_sales) AS DOUBLE) AS net_sales FROM wide
            WHERE product_name IS NOT NULL AND category IS NOT NULL
            GROUP BY product_id, product_name, category
            ORDER BY sum(wide.net_sales) DESC, product_id LIMIT 10"""
        ),
        "chart_city_customer_type": with_base(
            """SELECT 'city' AS panel, city AS label, CAST(sum(net_sales) AS DOUBLE) AS net_sales
            FROM wide GROUP BY city
            UNION ALL SELECT 'customer_type', customer_type, CAST(sum(net_sales) AS DOUBLE)
            FROM wide GROUP BY customer_type"""
        ),
        "chart_salesperson": with_base(
            f"SELECT salesperson, {MONEY2} FROM facts WHERE salesperson IS NOT NULL GROUP BY 1"
        ),
        "chart_payment_status": with_base(
            f"SELECT payment_status, net_sales, {text('share_pct')} AS slice_label FROM shares",
            STATUS_SHARES,
        ),
        "chart_discount_margin": with_base(
            f"""SELECT discount_band, margin_pct, {text('margin_pct')} AS bar_label
            FROM {_domain(BANDS, 'discount_band')} LEFT JOIN banded USING (discount_band)""",
            BANDED,
        ),
    }


def _filtered_charts() -> dict[str, str]:
    charts = _charts()
    person = f"salesperson = '{SLICE['salesperson']}'"
    category = (
        f"product_id IN (SELECT product_id FROM prod WHERE category = '{SLICE['category']}')"
    )
    cases = {
        "chart_monthly_trend": category,
        "chart_city_customer_type": person,
        "chart_discount_margin": f"{person} AND {category}",
    }
    return {f"{name}_filtered": _narrowed(charts[name], where) for name, where in cases.items()}


# Rules on the orders as they come in.
DELIVERED = (
    "dq_dup_id", "dq_dup_row", "dq_duplicate_ids", "dq_violations", "dq_summary", "dq_id_pages", "dq_affected_rows",
)


def statements() -> dict[str, str]:
    rules = _quality()
    return {
        **_filtered_charts(),
        **_sources(),
        **rules,
        **{name: delivered(rules[name]) for name in DELIVERED},
        **_cleaning(),
        **_sql_reports(),
        **_frame_reports(),
        **_findings(),
        **_charts(),
    }
