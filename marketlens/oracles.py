"""DuckDB SQL that each registered query is checked against.

``CTES`` holds named building blocks; ``with_ctes`` puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re

from marketlens.schemas import CHURN_DAYS, VALID_STATUSES
from marketlens.sources.binding import CORE_STATES, TARGET_CATEGORY, TRANSLATIONS


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def money(x: str) -> str:
    return f"SUM({x})"


def uniform(key: str, seed: int, stream: str) -> str:
    text = f"CAST({key} AS VARCHAR) || '|{seed}|{stream}'"
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def capitalize(x: str) -> str:
    t = f"replace({x}, '_', ' ')"
    return f"(upper(substr({t}, 1, 1)) || lower(substr({t}, 2)))"


def label(x: str) -> str:
    return f"coalesce({capitalize(x)}, 'Unknown')"


VALID = f"order_status IN {_in(VALID_STATUSES)}"
_TRANSLATED = ", ".join(f"('{k}', '{v}')" for k, v in TRANSLATIONS.items())

CTES: dict[str, str] = {
    "t_customers": """
        SELECT o_orderkey AS customer_id,
               o_custkey * 100 + (year(o_orderdate) - 1990) * 2
                 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS customer_unique_id,
               c_mktsegment AS customer_city, n_name AS customer_state
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "t_purchases": """
        SELECT *, CASE WHEN o_orderkey % 997 <> 0
                       THEN o_orderdate + to_seconds(o_orderkey * 7919 % 86400) END AS bought
        FROM orders""",
    "t_orders": """
        SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
               bought AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 53 <> 0
                    THEN bought + to_days(CAST(2 + o_orderkey * 31 % 28 AS INT)) + to_seconds(o_orderkey * 17 % 86400)
               END AS order_delivered_customer_date,
               CASE WHEN bought IS NOT NULL THEN date_trunc('day', bought)::TIMESTAMP + INTERVAL 20 DAY
               END AS order_estimated_delivery_date
        FROM t_purchases""",
    "t_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
        FROM lineitem""",
    "t_payments": """
        SELECT o_orderkey AS order_id,
               CASE o_orderkey % 4 WHEN 2 THEN 'boleto' WHEN 3 THEN 'debit_card' ELSE 'credit_card' END AS payment_type,
               CAST(1 + o_orderkey % 10 AS INT) AS payment_installments, o_totalprice AS payment_value
        FROM orders WHERE o_orderkey % 11 <> 0
        UNION ALL
        SELECT o_orderkey, 'voucher', 1, 10.0 FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0""",
    "t_products": """
        SELECT p_partkey AS product_id, CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS product_category_name
        FROM part""",
    "t_translation": f"""
        SELECT v.product_category_name, v.product_category_name_english
        FROM (VALUES {_TRANSLATED}) AS v(product_category_name, product_category_name_english)""",
    "payment_summary": """
        SELECT DISTINCT order_id, sum(payment_value) OVER whole AS payment_value,
               avg(payment_installments) OVER whole AS avg_installments, max(payment_type) OVER whole AS primary_payment_type
        FROM t_payments WINDOW whole AS (PARTITION BY order_id)""",
    "product_names": """
        SELECT product_id, ifnull(product_category_name_english, product_category_name) AS shown
        FROM t_products LEFT JOIN t_translation USING (product_category_name)""",
    # Every order as one list of its lines; all numbers come from the list.
    "order_lines": """
        SELECT order_id, list({product: product_id, seller: seller_id, price: price, freight: freight_value, shown: shown}) AS lines
        FROM t_items LEFT JOIN product_names USING (product_id) GROUP BY ALL""",
    "item_summary": """
        SELECT order_id, CAST(len(lines) AS BIGINT) AS item_count,
               CAST(len(list_distinct([x.product for x in lines])) AS BIGINT) AS distinct_product_count,
               CAST(len(list_distinct([x.seller for x in lines])) AS BIGINT) AS seller_count,
               list_sum([x.price for x in lines]) AS item_revenue, list_sum([x.freight for x in lines]) AS freight_value,
               list_max([x.shown for x in lines]) AS product_category
        FROM order_lines""",
    # Both summaries stacked, then folded to a row per order.
    "order_sides": """
        SELECT order_id, any_value(item_count) AS n, any_value(distinct_product_count) AS products,
               any_value(seller_count) AS sellers, any_value(item_revenue) AS goods, any_value(freight_value) AS freight,
               any_value(product_category) AS category, any_value(payment_value) AS paid,
               any_value(avg_installments) AS installments, any_value(primary_payment_type) AS means
        FROM (SELECT * FROM payment_summary UNION ALL BY NAME SELECT * FROM item_summary) GROUP BY order_id""",
    "fact_orders": """
        SELECT order_id, customer_unique_id, customer_city, customer_state, order_status,
               order_purchase_timestamp AS order_purchase_ts, order_delivered_customer_date AS delivered_customer_ts,
               order_estimated_delivery_date AS estimated_delivery_ts,
               ifnull(n, 0) AS item_count, ifnull(products, 0) AS distinct_product_count, ifnull(sellers, 0) AS seller_count,
               ifnull(goods, CAST(0 AS DOUBLE)) AS item_revenue, ifnull(freight, CAST(0 AS DOUBLE)) AS freight_value,
               ifnull(paid, ifnull(goods + freight, CAST(0 AS DOUBLE))) AS payment_value,
               ifnull(installments, CAST(1 AS DOUBLE)) AS avg_installments,
               ifnull(means, 'unknown') AS primary_payment_type, ifnull(category, 'unknown') AS product_category,
               CAST(ifnull(order_delivered_customer_date > order_estimated_delivery_date, false) AS INT) AS is_late_delivery
        FROM t_customers JOIN (SELECT * FROM t_orders WHERE order_purchase_timestamp IS NOT NULL) USING (customer_id)
             LEFT JOIN order_sides USING (order_id)""",
    "valid_orders": f"SELECT * FROM fact_orders WHERE {VALID}",
    # Per customer and category first; customers are sums of those.
    "customer_categories": """
        SELECT customer_unique_id, product_category, count(*) AS n, count(payment_value) AS paid_n, sum(payment_value) AS paid,
               sum(item_count) AS items, sum(is_late_delivery) AS late,
               min(order_purchase_ts) AS early, max(order_purchase_ts) AS recent
        FROM valid_orders GROUP BY ALL""",
    "customer_features": f"""
        SELECT customer_unique_id, CAST(sum(n) AS BIGINT) AS order_count, sum(paid) AS total_revenue,
               sum(paid) / sum(paid_n) AS avg_order_value, CAST(sum(items) AS BIGINT) AS total_items,
               sum(late) / sum(n) AS late_delivery_rate, min(early) AS first_purchase_ts, max(recent) AS last_purchase_ts,
               count(*) AS category_count,
               CAST(date_diff('day', max(recent), any_value(newest)) AS INT) AS recency_days,
               CAST(date_diff('day', min(early), max(recent)) AS INT) AS tenure_days,
               CAST(date_diff('day', max(recent), any_value(newest)) > {CHURN_DAYS} AS INT) AS churn_label
        FROM customer_categories, (SELECT max(order_purchase_ts) AS newest FROM fact_orders) GROUP BY customer_unique_id""",
    "state_category_daily_sales": """
        SELECT order_purchase_ts::DATE AS order_date, customer_state, product_category, count(*) AS orders, sum(payment_value) AS revenue
        FROM valid_orders GROUP BY ALL""",
    "category_daily_sales": """
        SELECT order_date, product_category, CAST(sum(orders) AS BIGINT) AS orders, sum(revenue) AS revenue
        FROM state_category_daily_sales GROUP BY ALL""",
    # The whole first order of each customer as one struct.
    "first_orders": """
        SELECT customer_unique_id, first(v ORDER BY order_purchase_ts, order_id) AS f, min(order_id) <> max(order_id) AS again
        FROM valid_orders v GROUP BY ALL""",
    "customer_repeat_features": """
        SELECT customer_unique_id, f.customer_state AS first_customer_state, f.product_category AS first_product_category,
               f.primary_payment_type AS first_payment_type, f.payment_value AS first_order_value, f.item_count AS first_item_count,
               f.freight_value AS first_freight_value, f.avg_installments AS first_avg_installments,
               f.is_late_delivery AS first_late_delivery,
               CAST(date_diff('day', f.order_purchase_ts, f.delivered_customer_ts) AS INT) AS first_delivery_days,
               CAST(month(f.order_purchase_ts) AS INT) AS first_order_month, CAST(again AS INT) AS repeat_purchase_label
        FROM first_orders""",
    "paid_orders": """
        SELECT order_id, payment_value FROM valid_orders WHERE payment_value IS NOT NULL""",
    "ab_test_sample": """
        SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(order_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2 = 0
                    THEN 'control' ELSE 'treatment' END AS variant,
               CASE WHEN payment_value >= (SELECT quantile_cont(payment_value, 0.5) FROM paid_orders)
                    THEN 1 ELSE 0 END AS converted,
               payment_value AS order_value
        FROM paid_orders""",
}


def with_ctes(statement: str) -> str:
    """Prefix a SELECT with the building blocks it names, in dependency order."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", sql):
                visit_body(name)

    def visit_body(name: str) -> None:
        pattern_free = CTES[name]
        for other in CTES:
            if other != name and other not in ordered and re.search(rf"\b(FROM|JOIN|,)\s+{other}\b", pattern_free):
                visit_body(other)
        if name not in ordered:
            ordered.append(name)

    visit(statement)
    if not ordered:
        return statement
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered) + "\n" + statement


ORACLES: dict[str, str] = {}


def oracle(name: str, statement: str | None = None) -> None:
    ORACLES[name] = with_ctes(statement or f"SELECT * FROM {name}")


for _name in [
    "payment_summary",
    "item_summary",
    "fact_orders",
    "customer_features",
    "category_daily_sales",
    "state_category_daily_sales",
    "customer_repeat_features",
    "ab_test_sample",
]:
    oracle(_name)


# --- sources and sinks ---------------------------------------------------------------------------

oracle(
    "raw_csv_round_trip",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id, order_status,
              order_purchase_timestamp, order_delivered_customer_date, order_estimated_delivery_date
       FROM t_orders""",
)
oracle(
    "ab_test_latest",
    """SELECT * FROM (WITH latest AS (
         SELECT order_id, payment_value FROM valid_orders WHERE payment_value IS NOT NULL ORDER BY order_purchase_ts DESC, order_id DESC LIMIT 1000)
       SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(order_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
              CASE WHEN payment_value >= (SELECT median(payment_value) FROM latest) THEN 1 ELSE 0 END AS converted, ROUND(payment_value, 4) AS order_value
       FROM latest)""",
)
oracle(
    "stored_fact_columns",
    "SELECT customer_state, COUNT(*) AS orders, ROUND(SUM(payment_value), 4) AS revenue FROM fact_orders GROUP BY 1",
)
oracle("daily_sales_round_trip", "SELECT * FROM category_daily_sales")
oracle(
    "monthly_refresh",
    """SELECT s.*, strftime(order_date, '%Y-%m') = (SELECT strftime(MAX(order_purchase_timestamp), '%Y-%m') FROM t_orders) AS was_written
       FROM category_daily_sales AS s""",
)
oracle(
    "metrics_json_round_trip",
    "SELECT ROUND(AVG(CASE WHEN order_count > 1 THEN 1 ELSE 0 END), 6) AS repeat_customer_rate FROM customer_features",
)

# --- growth views --------------------------------------------------------------------------------

CTES["kpi"] = f"""
    SELECT {money('payment_value')} AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
           COUNT(DISTINCT customer_unique_id) AS total_customers, AVG(is_late_delivery) AS late_delivery_rate,
           (SELECT AVG(CASE WHEN order_count > 1 THEN 1 ELSE 0 END) FROM customer_features) AS repeat_customer_rate,
           (SELECT product_category FROM fact_orders GROUP BY product_category
            ORDER BY {money('payment_value')} DESC, product_category LIMIT 1) AS top_category
    FROM fact_orders"""


def percent(x: str) -> str:
    return f"printf('%.1f%%', floor({x} * 1000 + 0.5) / 10)"


oracle(
    "kpi_summary",
    f"""SELECT total_revenue, total_orders, total_customers,
               ROUND(total_revenue / total_orders, 6) AS avg_order_value,
               ROUND(late_delivery_rate, 6) AS late_delivery_rate,
               ROUND(repeat_customer_rate, 6) AS repeat_customer_rate,
               top_category, {label('top_category')} AS top_category_display
        FROM kpi""",
)
oracle(
    "approximate_customers",
    """SELECT customer_state, COUNT(*) AS order_rows, COUNT(DISTINCT customer_unique_id) AS customers, true AS error_in_bound
       FROM fact_orders GROUP BY 1""",
)
oracle(
    "insight_lines",
    f"""SELECT 'Category leader' AS title, {label('top_category')} || ' brings in the most revenue here.' AS body FROM kpi
        UNION ALL SELECT 'Repeat behavior', {percent('repeat_customer_rate')} || ' of buyers came back for a second order.' FROM kpi
        UNION ALL SELECT 'Delivery signal', {percent('late_delivery_rate')} || ' of these orders came later than promised.' FROM kpi""",
)
oracle(
    "repeat_customer_rate",
    "SELECT ROUND(AVG(CASE WHEN order_count > 1 THEN 1 ELSE 0 END), 6) AS repeat_customer_rate FROM customer_features",
)
oracle(
    "filter_choices",
    """SELECT DISTINCT 'state' AS choice, customer_state AS value FROM fact_orders
       UNION ALL SELECT DISTINCT 'category', product_category FROM fact_orders
       UNION ALL SELECT 'min_date', CAST(CAST(MIN(order_purchase_ts) AS DATE) AS VARCHAR) FROM fact_orders
       UNION ALL SELECT 'max_date', CAST(CAST(MAX(order_purchase_ts) AS DATE) AS VARCHAR) FROM fact_orders""",
)
oracle(
    "filtered_orders",
    f"""SELECT * FROM fact_orders
        WHERE CAST(order_purchase_ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
          AND customer_state IN {_in(CORE_STATES)} AND product_category IN ('watches_gifts', 'sports_leisure')""",
)
oracle(
    "daily_revenue",
    f"""SELECT CAST(order_purchase_ts AS DATE) AS order_date, {money('payment_value')} AS revenue,
               COUNT(DISTINCT order_id) AS orders FROM fact_orders GROUP BY 1""",
)
oracle(
    "top_categories",
    f"""SELECT product_category, {money('payment_value')} AS revenue, {label('product_category')} AS product_category_display
        FROM fact_orders GROUP BY product_category ORDER BY revenue DESC, product_category LIMIT 10""",
)
oracle(
    "top_states",
    f"""SELECT customer_state, {money('payment_value')} AS revenue FROM fact_orders
        GROUP BY customer_state ORDER BY revenue DESC, customer_state LIMIT 12""",
)
CTES["mix"] = f"""
    SELECT customer_state, product_category, {label('product_category')} AS product_category_display,
           {money('payment_value')} AS revenue,
           {money('payment_value')} / (SELECT {money('payment_value')} FROM fact_orders) AS revenue_share
    FROM fact_orders GROUP BY customer_state, product_category
    ORDER BY revenue DESC, customer_state, product_category LIMIT 60"""
oracle(
    "state_category_mix",
    f"""SELECT customer_state, product_category, product_category_display, revenue,
               ROUND(revenue_share, 6) AS revenue_share, {percent('revenue_share')} AS share_label FROM mix""",
)
oracle(
    "state_category_rollup",
    f"""SELECT customer_state, product_category_display, {money('revenue')} AS revenue,
               ROUND(SUM(revenue_share), 6) AS revenue_share,
               CAST(GROUPING(customer_state, product_category_display) AS INT) AS level
        FROM mix GROUP BY ROLLUP (customer_state, product_category_display)""",
)
oracle(
    "first_orders",
    "SELECT customer_unique_id, f.order_id AS order_id, f.order_purchase_ts AS order_purchase_ts, f.payment_value AS payment_value FROM first_orders",
)
oracle(
    "feature_labels",
    f"""SELECT DISTINCT 'categorical__first_product_category_' || product_category AS encoded,
               'first_category=' || product_category AS feature,
               'First category: ' || {label('product_category')} AS feature_display FROM fact_orders
        UNION ALL SELECT DISTINCT 'categorical__first_customer_state_' || customer_state,
               'state=' || customer_state, 'State: ' || {label('customer_state')} FROM fact_orders
        UNION ALL SELECT DISTINCT 'categorical__first_payment_type_' || primary_payment_type,
               'payment=' || primary_payment_type, 'Payment: ' || {label('primary_payment_type')} FROM fact_orders""",
)

# --- audit ---------------------------------------------------------------------------------------

# Retail table, its building block, its columns.
_RAW = {
    "customers": ("t_customers", ["customer_id", "customer_unique_id", "customer_city", "customer_state"]),
    "orders": (
        "t_orders",
        ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
         "order_delivered_customer_date", "order_estimated_delivery_date"],
    ),
    "order_items": (
        "t_items", ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"],
    ),
    "order_payments": ("t_payments", ["order_id", "payment_type", "payment_installments", "payment_value"]),
    "products": ("t_products", ["product_id", "product_category_name"]),
    "category_translation": ("t_translation", ["product_category_name", "product_category_name_english"]),
}
_PROCESSED = [
    "fact_orders", "customer_features", "category_daily_sales", "state_category_daily_sales",
    "customer_repeat_features", "ab_test_sample",
]


def _check(name: str, status: str, value: str, number: str, detail: str, source: str) -> str:
    return (
        f"SELECT {name} AS \"check\", {status} AS status, CAST({value} AS VARCHAR) AS value, "
        f"CAST({number} AS DOUBLE) AS value_num, '{detail}' AS detail {source}"
    )


def _count_check(name: str, count: str, detail: str, source: str, zero: bool = False) -> str:
    status = "CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END" if zero else "'pass'"
    return _check(f"'{name}'", status, "n", "n", detail, f"FROM (SELECT {count} AS n {source})")


def _null_rates(name: str, block: str, columns: list[str]) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS col, 1 - COUNT({c}) / COUNT(*)::DOUBLE AS rate FROM {block}" for c in columns
    )
    rows = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY rate DESC, col) AS pos FROM ({each}))"
    return _check(
        f"'raw_null_rate__{name}__' || col",
        "CASE WHEN rate > 0.25 THEN 'warn' ELSE 'pass' END",
        "CAST(ROUND(rate, 4) AS DECIMAL(10,4))",
        "ROUND(rate, 4)",
        "largest shares of missing values",
        f"FROM {rows} WHERE pos <= 5",
    )


def _orphans(check: str, child: str, parent: str, key: str, detail: str) -> str:
    return _count_check(
        f"referential_integrity__{check}",
        "COUNT(*)",
        detail,
        f"FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})",
        True,
    )


_DQ = {
    "dq_raw_files": [
        f"SELECT 'raw_file_exists__{name}' AS \"check\", 'pass' AS status, 'true' AS value, "
        f"1.0::DOUBLE AS value_num, 'input file of table {name}' AS detail"
        for name in _RAW
    ],
    "raw_counts": [
        _count_check(f"raw_row_count__{name}", "COUNT(*)", "rows read from the input", f"FROM {block}")
        for name, (block, _) in _RAW.items()
    ],
    "processed_counts": [
        _count_check(f"processed_row_count__{name}", "COUNT(*)", "rows of the derived table", f"FROM {name}")
        for name in _PROCESSED
    ],
    "dq_duplicate_keys": [
        _count_check(
            f"raw_duplicate_key_count__{name}",
            "COALESCE(SUM(c - 1), 0)",
            f"rows beyond the first per {key}",
            f"FROM (SELECT COUNT(*) AS c FROM {block} GROUP BY {key})",
            True,
        )
        for name, block, key in [
            ("customers", "t_customers", "customer_id"),
            ("orders", "t_orders", "order_id"),
            ("products", "t_products", "product_id"),
            ("category_translation", "t_translation", "product_category_name"),
        ]
    ],
    "dq_null_rates": [_null_rates(name, block, columns) for name, (block, columns) in _RAW.items()],
    "dq_referential_integrity": [
        _orphans("orders_to_customers", "t_orders", "t_customers", "customer_id",
                 "orders that name no known customer"),
        _orphans("items_to_orders", "t_items", "t_orders", "order_id",
                 "items of an order that is not there"),
        _orphans("payments_to_orders", "t_payments", "t_orders", "order_id",
                 "payments for an order that is not there"),
        _orphans("items_to_products", "t_items", "t_products", "product_id",
                 "items of a product that is not listed"),
    ],
    "dq_fact_checks": [
        _check("'fact_orders__positive_payment_rate'", "'pass'", "CAST(ROUND(r, 4) AS DECIMAL(10,4))", "ROUND(r, 4)",
               "orders with a payment above zero",
               "FROM (SELECT AVG(CASE WHEN payment_value > 0 THEN 1 ELSE 0 END) AS r FROM fact_orders)"),
        _check("'fact_orders__date_range'", "'pass'",
               "'{\"min_order_purchase_ts\":\"' || strftime(lo, '%Y-%m-%d %H:%M:%S') || "
               "'\",\"max_order_purchase_ts\":\"' || strftime(hi, '%Y-%m-%d %H:%M:%S') || '\"}'",
               "NULL", "first and last purchase time",
               "FROM (SELECT MIN(order_purchase_ts) AS lo, MAX(order_purchase_ts) AS hi FROM fact_orders)"),
        _check("'customer_repeat_features__repeat_rate'", "'pass'", "CAST(ROUND(r, 4) AS DECIMAL(10,4))", "ROUND(r, 4)",
               "share of buyers with a second order",
               "FROM (SELECT AVG(repeat_purchase_label) AS r FROM customer_repeat_features)"),
    ],
}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


for _name in ("dq_duplicate_keys", "dq_null_rates", "dq_referential_integrity", "dq_fact_checks"):
    oracle(_name, _union(_DQ[_name]))
oracle("dq_row_counts", _union(_DQ["raw_counts"] + _DQ["processed_counts"]))
_REPORT = _union([part for parts in _DQ.values() for part in parts])
oracle("dq_report", _REPORT)
oracle("dq_report_files", f"SELECT *, unnest(['json', 'csv']) AS format FROM ({_REPORT})")
oracle(
    "dq_status_rollup",
    f"""SELECT CASE WHEN COUNT(*) FILTER (status = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS overall_status,
               COUNT(*) FILTER (status = 'pass') AS passed, COUNT(*) FILTER (status = 'warn') AS warned,
               COUNT(*) FILTER (status = 'fail') AS failed, COUNT(*) AS checks FROM ({_REPORT})""",
)
oracle("dq_status_counts", f"SELECT status, COUNT(*) AS checks FROM ({_REPORT}) GROUP BY status")
oracle("dq_filtered_checks", f"SELECT * FROM ({_REPORT}) WHERE status IN ('pass', 'warn')")

# --- forecasts -----------------------------------------------------------------------------------

CTES["scopes"] = """
    SELECT order_date, customer_state, product_category, revenue FROM state_category_daily_sales
    UNION ALL SELECT order_date, 'ALL', product_category, revenue FROM state_category_daily_sales"""
CTES["scope_sums"] = f"""
    SELECT customer_state, product_category, order_date, {money('revenue')} AS revenue
    FROM scopes GROUP BY 1, 2, 3"""
CTES["scope_grid"] = """
    SELECT customer_state, product_category,
           CAST(unnest(generate_series(MIN(order_date), MAX(order_date), INTERVAL 1 DAY)) AS DATE) AS order_date
    FROM scope_sums GROUP BY 1, 2"""
CTES["daily_series"] = """
    SELECT g.order_date, g.customer_state, g.product_category, COALESCE(s.revenue, 0.0::DOUBLE) AS revenue
    FROM scope_grid g LEFT JOIN scope_sums s
      ON g.customer_state = s.customer_state AND g.product_category = s.product_category AND g.order_date = s.order_date"""
CTES["sized_series"] = """
    SELECT *, CAST(LEAST(28, GREATEST(7, days // 8)) AS INT) AS width FROM (
      SELECT *, COUNT(*) OVER (PARTITION BY customer_state, product_category) AS days,
             ROW_NUMBER() OVER (PARTITION BY customer_state, product_category ORDER BY order_date DESC) AS back
      FROM daily_series)"""
CTES["rolling"] = """
    SELECT *, CASE WHEN COUNT(*) OVER w >= 7 THEN
                AVG(revenue) OVER w END AS rolling_mean
    FROM sized_series
    WINDOW w AS (PARTITION BY customer_state, product_category ORDER BY order_date
                 ROWS BETWEEN width - 1 PRECEDING AND CURRENT ROW)"""
CTES["levels"] = """
    SELECT customer_state, product_category, MAX(order_date) AS last_date,
           AVG(revenue) FILTER (back <= width) AS level, stddev_samp(revenue - rolling_mean) AS residual_std
    FROM rolling WHERE days >= 35 GROUP BY 1, 2"""
CTES["ma_forecast"] = """
    SELECT CAST(last_date + to_days(CAST(h AS INT)) AS DATE) AS order_date, customer_state, product_category,
           ROUND(GREATEST(level, 0), 4) AS forecast_revenue,
           ROUND(GREATEST(level - 1.2815515655446004::DOUBLE * residual_std * sqrt(h), 0), 4) AS lower_revenue,
           ROUND(GREATEST(level + 1.2815515655446004::DOUBLE * residual_std * sqrt(h), 0), 4) AS upper_revenue
    FROM levels, generate_series(1, 30) AS g(h)"""
oracle(
    "forecast_scope",
    f"""SELECT customer_state, product_category, {money('revenue')} AS revenue FROM state_category_daily_sales
        GROUP BY 1, 2 ORDER BY revenue DESC, customer_state, product_category LIMIT 1""",
)
oracle(
    "forecast_scope_choices",
    f"""SELECT product_category, {money('revenue')} AS revenue FROM state_category_daily_sales
        WHERE customer_state = 'NATION_7' GROUP BY 1""",
)
oracle("daily_series")
oracle(
    "series_status",
    """SELECT customer_state, product_category, COUNT(*) AS days,
              CASE WHEN COUNT(*) >= 35 THEN 'ok' ELSE 'too short' END AS status
       FROM daily_series GROUP BY 1, 2""",
)
oracle(
    "rolling_residuals",
    """SELECT order_date, customer_state, product_category, revenue, width, ROUND(rolling_mean + 3e-8, 6) AS rolling_mean
       FROM rolling""",
)
oracle(
    "forecast_moving_average",
    """SELECT *, 'ok' AS status FROM ma_forecast
       UNION ALL SELECT NULL, customer_state, product_category, NULL, NULL, NULL, 'too short'
       FROM daily_series GROUP BY customer_state, product_category HAVING COUNT(*) < 35""",
)
oracle(
    "forecast_overlay",
    f"""SELECT order_date, customer_state, product_category, 'actual' AS kind, ROUND(revenue, 4) AS revenue,
               NULL::DOUBLE AS lower_revenue, NULL::DOUBLE AS upper_revenue
        FROM daily_series WHERE customer_state = 'ALL' AND product_category = '{TARGET_CATEGORY}'
        UNION ALL
        SELECT order_date, customer_state, product_category, 'forecast', forecast_revenue, lower_revenue, upper_revenue
        FROM ma_forecast WHERE customer_state = 'ALL' AND product_category = '{TARGET_CATEGORY}'""",
)

# --- feature preparation -------------------------------------------------------------------------

_NUMERIC = [
    "first_order_value", "first_item_count", "first_freight_value", "first_avg_installments",
    "first_late_delivery", "first_delivery_days", "first_order_month",
]
CTES["imputed"] = """
    SELECT * REPLACE (COALESCE(CAST(first_delivery_days AS DOUBLE), (SELECT quantile_cont(first_delivery_days, 0.5) FROM customer_repeat_features))
                      AS first_delivery_days)
    FROM customer_repeat_features"""
oracle(
    "impute_median",
    "SELECT customer_unique_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NUMERIC) + " FROM imputed",
)
CTES["blanked"] = """
    SELECT customer_unique_id, NULLIF(first_payment_type, 'unknown') AS first_payment_type,
           first_customer_state FROM customer_repeat_features"""
oracle(
    "impute_mode",
    """SELECT customer_unique_id, COALESCE(first_payment_type,
                (SELECT first_payment_type FROM blanked WHERE first_payment_type IS NOT NULL
                 GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS first_payment_type, first_customer_state
       FROM blanked""",
)
oracle(
    "standardize",
    "SELECT customer_unique_id, "
    + ", ".join(f"ROUND((b.{c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}_z" for c in _NUMERIC)
    + " FROM imputed b, (SELECT "
    + ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUMERIC)
    + " FROM imputed)",
)
_IS_TRAIN = f"CASE WHEN {uniform('customer_unique_id', 42, 'split')} < 0.25 THEN 0 ELSE 1 END"


CTES["split_rows"] = f"SELECT *, {_IS_TRAIN} AS is_train FROM customer_repeat_features"
CTES["category_levels"] = """
    SELECT first_product_category AS k, COUNT(*) AS n FROM split_rows WHERE is_train = 1 GROUP BY 1"""
CTES["state_levels"] = """
    SELECT first_customer_state AS k, COUNT(*) AS n FROM split_rows WHERE is_train = 1 GROUP BY 1"""
oracle(
    "pool_rare_categories",
    """SELECT customer_unique_id,
              CASE WHEN c.n IS NULL THEN '__unseen__' WHEN c.n < 250 THEN 'infrequent_sklearn' ELSE c.k END AS first_product_category_level,
              CASE WHEN s.n IS NULL THEN '__unseen__' WHEN s.n < 250 THEN 'infrequent_sklearn' ELSE s.k END AS first_customer_state_level
       FROM split_rows r LEFT JOIN category_levels c ON r.first_product_category = c.k
            LEFT JOIN state_levels s ON r.first_customer_state = s.k""",
)
oracle("seeded_split", "SELECT customer_unique_id, repeat_purchase_label, is_train FROM split_rows")
oracle(
    "stratified_split",
    f"""SELECT customer_unique_id, repeat_purchase_label,
               CASE WHEN ROW_NUMBER() OVER (PARTITION BY repeat_purchase_label
                                            ORDER BY {uniform('customer_unique_id', 42, 'split')}, customer_unique_id)
                         <= ROUND(0.25 * COUNT(*) OVER (PARTITION BY repeat_purchase_label)) THEN 0 ELSE 1 END AS is_train
        FROM customer_repeat_features""",
)

# --- evaluation of given scores ------------------------------------------------------------------

CTES["scored"] = f"""
    SELECT *, floor((0.8::DOUBLE * {uniform('customer_unique_id', 7, 'score')} + 0.2::DOUBLE * repeat_purchase_label) * 1000) / 1000.0::DOUBLE
           AS repeat_probability
    FROM customer_repeat_features"""
CTES["percentiles"] = """
    SELECT customer_unique_id, repeat_probability,
           ROW_NUMBER() OVER (ORDER BY repeat_probability, customer_unique_id) / COUNT(*) OVER ()::DOUBLE AS propensity_percentile
    FROM scored"""
CTES["banded"] = """
    SELECT *, CASE WHEN propensity_percentile >= 0.90 THEN 'High' WHEN propensity_percentile >= 0.60 THEN 'Medium' ELSE 'Low' END
              AS propensity_band FROM percentiles"""
oracle("propensity_bands", "SELECT * FROM banded")
oracle(
    "band_counts",
    """SELECT propensity_band, COUNT(*) AS customers,
              CASE propensity_band WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS band_order
       FROM banded GROUP BY propensity_band""",
)
CTES["score_ranks"] = """
    SELECT repeat_purchase_label AS label, COUNT(*) OVER () AS total, AVG(repeat_purchase_label) OVER () AS baseline,
           ROW_NUMBER() OVER (ORDER BY repeat_probability DESC, customer_unique_id) AS pos FROM scored"""
oracle(
    "topk_lift",
    """SELECT 'Top ' || CAST(f * 100 AS INT) || '%' AS population_slice, COUNT(*) AS customers,
              ROUND(AVG(label), 6) AS repeat_rate, ROUND(AVG(label) / ANY_VALUE(baseline), 6) AS lift_vs_baseline
       FROM score_ranks, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) AS v(f)
       WHERE pos <= GREATEST(1, floor(total * f)) GROUP BY f""",
)
CTES["confusion"] = """
    SELECT COUNT(*) FILTER (p AND a) AS tp, COUNT(*) FILTER (p AND NOT a) AS fp, COUNT(*) FILTER (NOT p AND a) AS fn,
           COUNT(*) FILTER (p = a) AS hits, COUNT(*) FILTER (a) AS positives, COUNT(*) AS total
    FROM (SELECT repeat_probability >= 0.5 AS p, repeat_purchase_label = 1 AS a FROM scored)"""
oracle(
    "classification_metrics",
    """SELECT ROUND(hits / total, 6) AS accuracy, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS "precision",
              ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall,
              ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1,
              ROUND(positives / total, 6) AS target_rate, total AS test_rows FROM confusion""",
)
CTES["score_counts"] = """
    SELECT repeat_probability AS score, COUNT(*) FILTER (repeat_purchase_label = 1) AS pos,
           COUNT(*) FILTER (repeat_purchase_label = 0) AS neg FROM scored GROUP BY 1"""
oracle(
    "roc_auc",
    """SELECT ROUND(SUM(hi.pos * (CASE WHEN hi.score > lo.score THEN 1.0 ELSE 0.5 END) * lo.neg)::DOUBLE
                    / (SELECT SUM(pos)::DOUBLE * SUM(neg)::DOUBLE FROM score_counts), 6) AS roc_auc
       FROM score_counts hi JOIN score_counts lo ON hi.score >= lo.score""",
)
oracle(
    "average_precision",
    """SELECT ROUND(SUM(pos * cp / (cp + cn)) / SUM(pos), 6) AS average_precision FROM (
         SELECT pos, CAST(SUM(pos) OVER w AS DOUBLE) AS cp, CAST(SUM(neg) OVER w AS DOUBLE) AS cn
         FROM score_counts WINDOW w AS (ORDER BY score DESC))""",
)


def _score_summary(group: str) -> str:
    return f"""
    SELECT {group}, COUNT(DISTINCT customer_unique_id) AS customers,
           ROUND(AVG(repeat_purchase_label), 6) AS actual_repeat_rate,
           ROUND(AVG(repeat_probability), 6) AS avg_repeat_probability
    FROM scored GROUP BY 1"""


CTES["by_state"] = _score_summary("first_customer_state")
CTES["by_category"] = _score_summary("first_product_category")
oracle("score_by_state", "SELECT * FROM by_state")
oracle("score_by_category", "SELECT * FROM by_category")
oracle(
    "state_summary_display",
    f"""SELECT {label('first_customer_state')} AS "First customer state", customers AS "Customers",
               actual_repeat_rate AS "Actual repeat rate", avg_repeat_probability AS "Avg repeat probability" FROM by_state""",
)
oracle(
    "propensity_by_state",
    "SELECT * FROM by_state ORDER BY avg_repeat_probability DESC, first_customer_state LIMIT 12",
)
oracle(
    "propensity_by_category",
    f"""SELECT *, {label('first_product_category')} AS first_product_category_display FROM by_category
        WHERE customers >= 100 ORDER BY avg_repeat_probability DESC, first_product_category LIMIT 15""",
)
oracle(
    "best_prospects",
    f"""SELECT customer_unique_id, {label('first_product_category')} AS first_product_category, repeat_probability
        FROM scored ORDER BY repeat_probability DESC, customer_unique_id LIMIT 100""",
)

# --- segments ------------------------------------------------------------------------------------

CTES["id_groups"] = """
    SELECT CAST(year(last_purchase_ts) AS INT) AS cluster, COUNT(DISTINCT customer_unique_id) AS customers,
           AVG(recency_days) AS recency_days, AVG(order_count) AS order_count, AVG(total_revenue) AS total_revenue,
           AVG(avg_order_value) AS avg_order_value, AVG(churn_label) AS churn_rate
    FROM customer_features GROUP BY 1"""
CTES["group_ranks"] = """
    SELECT *, RANK() OVER (ORDER BY total_revenue DESC) + (COUNT(*) OVER (PARTITION BY total_revenue) - 1) / 2
            + RANK() OVER (ORDER BY order_count DESC) + (COUNT(*) OVER (PARTITION BY order_count) - 1) / 2
            + RANK() OVER (ORDER BY recency_days) + (COUNT(*) OVER (PARTITION BY recency_days) - 1) / 2 AS value_score
    FROM id_groups"""
oracle(
    "segment_names",
    """SELECT cluster, customers, ROUND(recency_days, 4) AS recency_days, ROUND(order_count, 4) AS order_count,
              ROUND(total_revenue, 4) AS total_revenue, ROUND(avg_order_value, 4) AS avg_order_value,
              ROUND(churn_rate, 4) AS churn_rate,
              (['Champions', 'Loyal', 'Promising', 'At Risk'])[LEAST(4, ROW_NUMBER() OVER (ORDER BY value_score, cluster))] AS segment_name
       FROM group_ranks""",
)

# --- experiments ---------------------------------------------------------------------------------

_SEED = 20260514
CTES["joined_scores"] = """
    SELECT f.*, s.repeat_probability AS score FROM customer_repeat_features f
    LEFT JOIN (SELECT * FROM scored WHERE first_delivery_days IS NOT NULL) s USING (customer_unique_id)"""
CTES["frame"] = """
    SELECT * EXCLUDE (score), COALESCE(score, (SELECT quantile_cont(score, 0.5) FROM joined_scores)) AS repeat_probability
    FROM joined_scores"""
oracle(
    "experiment_frame",
    "SELECT customer_unique_id, repeat_probability, first_order_value, repeat_purchase_label FROM frame",
)
CTES["later"] = """
    SELECT v.customer_unique_id AS id, ifnull(sum(v.payment_value) FILTER (v.order_id <> f.order_id), 0.0::DOUBLE) AS outcome
    FROM valid_orders v JOIN first_orders USING (customer_unique_id) GROUP BY ALL"""
CTES["participants"] = f"""
    SELECT f.customer_unique_id AS id, f.*, COALESCE(later.outcome, 0.0::DOUBLE) AS outcome,
           CAST(CAST(('0x' || substr(md5(CAST(f.customer_unique_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2 AS INT) AS treatment,
           CASE WHEN first_customer_state IN {_in(CORE_STATES)} THEN 1 ELSE 0 END AS core,
           CASE WHEN first_product_category = '{TARGET_CATEGORY}' THEN 1 ELSE 0 END AS target
    FROM frame f LEFT JOIN later ON f.customer_unique_id = later.id"""
oracle(
    "experiment_rows",
    """SELECT customer_unique_id, treatment, core AS core_market, target AS target_category_affinity, ROUND(outcome, 4) AS outcome
       FROM participants""",
)
oracle(
    "experiment_covariates",
    """SELECT customer_unique_id, treatment, core AS core_market, target AS target_category_affinity,
              ROUND(ln(1 + GREATEST(first_item_count, 1)), 4) AS log_items,
              ROUND(LEAST(GREATEST(first_order_value, 0), 500), 4) AS bounded_value, ROUND(z, 4) AS score_z,
              ROUND(1 / (1 + exp(-z)), 4) AS score_logistic, ROUND(outcome - arm, 4) AS centred_outcome
       FROM (SELECT *, (LEAST(GREATEST(repeat_probability, 0), 1) - AVG(LEAST(GREATEST(repeat_probability, 0), 1)) OVER ())
                       / GREATEST(stddev_pop(LEAST(GREATEST(repeat_probability, 0), 1)) OVER (), 1e-6) AS z,
                    AVG(outcome) OVER (PARTITION BY treatment) AS arm FROM participants)""",
)
_LEARNER = "given predictions"
CTES["overview"] = """
    SELECT COUNT(*) AS customers, CAST(SUM(treatment) AS BIGINT) AS treated, CAST(SUM(1 - treatment) AS BIGINT) AS controls,
           AVG(core * target) AS target_rate, AVG(outcome) AS average_outcome FROM participants"""
oracle(
    "experiment_summary",
    f"""SELECT 'customer' AS unit, 'Watches gifts' AS target_category_display,
               'half of the customers, by a hash of their id' AS assignment, 'revenue after the first order' AS outcome,
               '{_LEARNER}' AS base_learner, customers, treated AS treated_customers, controls AS control_customers,
               ROUND(target_rate, 4) AS target_rate, ROUND(average_outcome, 4) AS average_outcome FROM overview""",
)
CTES["arms"] = """
    SELECT AVG(outcome) FILTER (treatment = 1) AS m1, AVG(outcome) FILTER (treatment = 0) AS m0,
           COUNT(*) FILTER (treatment = 1) AS n1, COUNT(*) FILTER (treatment = 0) AS n0,
           var_samp(outcome) FILTER (treatment = 1) / COUNT(*) FILTER (treatment = 1) AS v1,
           var_samp(outcome) FILTER (treatment = 0) / COUNT(*) FILTER (treatment = 0) AS v0
    FROM participants"""
CTES["welch_numbers"] = """
    SELECT m1 - m0 AS estimate, sqrt(v1 + v0) AS standard_error, (m1 - m0) / sqrt(v1 + v0) AS statistic,
           (v1 + v0) * (v1 + v0) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)) AS freedom, n1, n0 FROM arms"""


def p_value(source: str) -> str:
    """Tail share of Student's density by Simpson's rule over asinh(t), for the one row of ``source``."""

    def area(start: str) -> str:
        y = f"({start} + i * 0.0075::DOUBLE)"
        weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        sinh, cosh = f"((exp({y}) - exp(-{y})) / 2)", f"((exp({y}) + exp(-{y})) / 2)"
        return f"SUM({weight} * exp(-(freedom + 1) / 2 * ln(1 + {sinh} * {sinh} / freedom)) * {cosh})"

    t = "abs(statistic)"
    return f"(SELECT {area(f'ln({t} + sqrt({t} * {t} + 1))')} / {area('0')} FROM {source}, range(0, 4001) AS s(i))"


CTES["welch"] = f"SELECT *, {p_value('welch_numbers')} AS p FROM welch_numbers"
oracle(
    "welch_test",
    """SELECT ROUND(estimate, 4) AS estimate, ROUND(standard_error, 4) AS standard_error, ROUND(statistic, 4) AS statistic,
              ROUND(freedom, 4) AS freedom, n1 AS treated_rows, n0 AS control_rows, ROUND(p, 6) AS p_value,
              p < 0.05 AS is_significant_05 FROM welch""",
)
CTES["holdout"] = f"""
    SELECT *, floor({uniform('id', 11, 'tau')} * 50 * 100) / 100.0::DOUBLE AS tau_hat,
           floor({uniform('id', 11, 'm')} * 30000) / 100.0::DOUBLE AS m_hat
    FROM participants WHERE {uniform('id', _SEED, 'split')} < 0.5"""
CTES["selected"] = """
    SELECT *, CASE WHEN tau_hat >= cutoff THEN 1 ELSE 0 END AS chosen,
           tau_hat + (treatment / 0.5) * (outcome - (m_hat - 0.5 * tau_hat + tau_hat))
             - ((1 - treatment) / (1 - 0.5)) * (outcome - (m_hat - 0.5 * tau_hat)) AS aipw
    FROM holdout, (SELECT quantile_cont(tau_hat, 0.95) AS cutoff FROM holdout)"""
oracle(
    "uplift_cutoff",
    "SELECT customer_unique_id, tau_hat, ROUND(cutoff, 6) AS cate_cutoff, chosen AS selected_segment FROM selected",
)
oracle("aipw_scores", "SELECT customer_unique_id, treatment, tau_hat, ROUND(aipw, 4) AS aipw_score FROM selected")
oracle(
    "pseudo_outcomes",
    """SELECT customer_unique_id, ROUND((outcome - m_hat) / (treatment - 0.5::DOUBLE), 4) AS pseudo_tau,
              (treatment - 0.5::DOUBLE) * (treatment - 0.5::DOUBLE) AS r_weight FROM selected""",
)
CTES["segment_numbers"] = """
    SELECT m AS estimate, s / sqrt(n) AS standard_error, m / (s / sqrt(n)) AS statistic, CAST(n - 1 AS DOUBLE) AS freedom, n
    FROM (SELECT AVG(aipw) AS m, stddev_samp(aipw) AS s, COUNT(*) AS n FROM selected WHERE chosen = 1)"""
CTES["segment_test"] = f"SELECT *, {p_value('segment_numbers')} AS p FROM segment_numbers"
oracle(
    "one_sample_test",
    """SELECT ROUND(estimate, 4) AS estimate, ROUND(standard_error, 4) AS standard_error, ROUND(statistic, 4) AS statistic,
              freedom, n AS "rows", ROUND(p, 6) AS p_value, p < 0.05 AS is_significant_05 FROM segment_test""",
)


def _profile(label_text: str, where: str) -> str:
    return f"""SELECT '{label_text}' AS segment, COUNT(*) AS customers, ROUND(AVG(treatment), 4) AS treatment_rate,
                      ROUND(AVG(outcome), 4) AS average_outcome, ROUND(AVG(tau_hat), 4) AS predicted_cate
               FROM selected {where}"""


oracle(
    "uplift_segment_profile",
    _profile("All holdout customers", "") + " UNION ALL " + _profile("Top 5% predicted CATE", "WHERE chosen = 1"),
)


def _test_line(method: str, estimand: str, source: str) -> str:
    four = ", ".join(f"printf('%.4f', {c}) AS {n}" for c, n in (("estimate", "estimate"), ("standard_error", "std_error"), ("statistic", "statistic"), ("p", "p_value")))
    return f"SELECT '{method}' AS method, '{estimand}' AS estimand, {four}, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS reject_at_5pct FROM {source}"


oracle(
    "method_comparison",
    _test_line("Difference in means", "Global ATE", "welch")
    + " UNION ALL "
    + _test_line(f"Holdout AIPW ({_LEARNER})", "ATE inside top 5% predicted CATE segment", "segment_test"),
)
oracle(
    "lesson_flags",
    "SELECT welch.p < 0.05 AS naive_rejects_05, segment_test.p < 0.05 AS r_learner_rejects_05 FROM welch, segment_test",
)
oracle(
    "r_learner_scores",
    f"""SELECT customer_unique_id, treatment, true AS effect_on_test_only, true AS segment_fits, true AS score_fits,
               CASE WHEN ROW_NUMBER() OVER (PARTITION BY treatment ORDER BY {uniform('id', _SEED, 'split')}, id)
                         <= ROUND(0.5 * COUNT(*) OVER (PARTITION BY treatment)) THEN 'test' ELSE 'train' END AS split
        FROM participants""",
)
oracle(
    "experiment_readout",
    f"""SELECT 'Customers' AS metric, format('{{:,}}', customers) AS value FROM overview
       UNION ALL SELECT 'Treated customers', format('{{:,}}', treated) FROM overview
       UNION ALL SELECT 'Control customers', format('{{:,}}', controls) FROM overview
       UNION ALL SELECT 'Customers in the target', printf('%.2f', 100 * target_rate) || '%' FROM overview
       UNION ALL SELECT 'Average outcome', printf('%.2f', average_outcome) FROM overview
       UNION ALL SELECT 'Difference in means', printf('%.2f', estimate) FROM welch
       UNION ALL SELECT 'Difference in means, p', printf('%.4f', p) FROM welch
       UNION ALL SELECT 'Selected segment', printf('%.2f', estimate) FROM segment_test
       UNION ALL SELECT 'Selected segment, p', printf('%.4f', p) FROM segment_test
       UNION ALL SELECT 'Only the segment test rejects', CASE WHEN segment_test.p < 0.05 AND welch.p >= 0.05 THEN 'yes' ELSE 'no' END
                 FROM segment_test, welch
       UNION ALL SELECT 'Base learner', '{_LEARNER}'""",
)

# --- models --------------------------------------------------------------------------------------

CTES["model_rows"] = f"""
    SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY repeat_purchase_label
                                           ORDER BY {uniform('customer_unique_id', 42, 'split')}, customer_unique_id)
                        <= ROUND(0.25 * COUNT(*) OVER (PARTITION BY repeat_purchase_label)) THEN 0 ELSE 1 END AS is_train
    FROM customer_repeat_features"""
oracle(
    "propensity_model_scores",
    "SELECT customer_unique_id, repeat_purchase_label, is_train, true AS is_probability, true AS band_fits FROM model_rows",
)
oracle(
    "propensity_model_metrics",
    """SELECT COUNT(*) FILTER (is_train = 0) AS test_rows, ROUND(AVG(repeat_purchase_label), 6) AS repeat_rate,
              true AS accuracy_agrees, true AS roc_auc_agrees FROM model_rows""",
)


def _level_names(column: str, prefix: str) -> str:
    return f"""SELECT DISTINCT '{prefix}=' || CASE WHEN n < 50 THEN 'infrequent_sklearn' ELSE level END AS feature
               FROM (SELECT {column} AS level, COUNT(*) AS n FROM model_rows WHERE is_train = 1 GROUP BY 1)"""


oracle(
    "feature_importance",
    "SELECT feature, true AS is_stationary FROM ("
    + " UNION ALL ".join(
        [f"SELECT unnest([{', '.join(repr(c) for c in _NUMERIC)}]) AS feature"]
        + [
            _level_names(c, p)
            for c, p in (("first_customer_state", "state"), ("first_product_category", "first_category"), ("first_payment_type", "payment"))
        ]
    )
    + ")",
)
oracle("top_drivers", "SELECT CAST(i AS INT) AS position, true AS in_order, true AS name_fits FROM range(1, 16) AS r(i)")
oracle("segment_customers", "SELECT customer_unique_id, true AS has_name, true AS nearest_centre FROM customer_features")
oracle(
    "segment_summary",
    "SELECT unnest(['Champions', 'Loyal', 'Promising', 'At Risk']) AS segment_name, true AS profile_agrees",
)
_BOUNDS = """
    SELECT CAST(last_date + to_days(CAST(h AS INT)) AS DATE) AS order_date, customer_state, product_category, 'ok' AS status, true AS in_bounds
    FROM levels, generate_series(1, 30) AS g(h)
    UNION ALL SELECT NULL, customer_state, product_category, 'too short', NULL
    FROM daily_series GROUP BY customer_state, product_category HAVING COUNT(*) < 35"""
oracle("forecast_ets", _BOUNDS)
oracle("forecast_sarima", _BOUNDS)
oracle(
    "arima_orthogonality",
    """SELECT customer_state, product_category, true AS is_orthogonal
       FROM daily_series GROUP BY 1, 2 HAVING COUNT(*) >= 35""",
)
# Every weight of the grid folds over the days; the season's list turns by one place a day.
oracle(
    "forecast_ets_scope",
    f"""SELECT * FROM (
          WITH RECURSIVE days AS (
            SELECT ROW_NUMBER() OVER (ORDER BY order_date) - 1 AS t, revenue AS y, COUNT(*) OVER () AS n, MAX(order_date) OVER () AS last_date
            FROM daily_series WHERE customer_state = 'ALL' AND product_category = '{TARGET_CATEGORY}'),
          weeks AS (SELECT t // 7 AS w, AVG(y) AS m FROM days WHERE t < n // 7 * 7 GROUP BY 1),
          slopes AS (SELECT (arg_max(m, w) - arg_min(m, w)) / (7 * MAX(w)) AS slope, arg_min(m, w) AS m0 FROM weeks),
          pattern AS (SELECT list(p ORDER BY j) AS season FROM (
            SELECT t % 7 AS j, AVG(y - m - slope * (t % 7 - 3)) AS p FROM days JOIN weeks ON t // 7 = w, slopes GROUP BY 1)),
          weights AS (SELECT row_number() OVER (ORDER BY a, b, g) AS i, a, b, g FROM
            (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]::DOUBLE[]) AS a), (SELECT unnest([0.0, 0.01, 0.05, 0.15]::DOUBLE[]) AS b),
            (SELECT unnest([0.0, 0.02, 0.05, 0.1, 0.25]::DOUBLE[]) AS g)),
          fold AS (
            SELECT i, a, b, g, 0::BIGINT AS t, m0 - slope * 4 AS level, slope AS trend, season, 0.0::DOUBLE AS squares, 0.0::DOUBLE AS total
            FROM weights, slopes, pattern
            UNION ALL
            SELECT i, a, b, g, t + 1, level + trend + a * e, trend + a * b * e, list_append(season[2:], season[1] + g * (1 - a) * e), squares + e * e, total + e
            FROM (SELECT f.*, d.y - (f.level + f.trend + f.season[1]) AS e FROM fold f JOIN days d ON f.t = d.t)),
          best AS (SELECT f.*, n, last_date FROM fold f JOIN (SELECT DISTINCT n, last_date FROM days) ON t = n ORDER BY squares, i LIMIT 1),
          ahead AS (
            SELECT last_date, h, level + h * trend + season[(h - 1) % 7 + 1] AS mean,
                   1.2815515655446004::DOUBLE * sqrt((squares - total * total / n) / (n - 1)) * sqrt(h) AS width
            FROM best, generate_series(1, 30) AS s(h))
          SELECT CAST(last_date + to_days(CAST(h AS INT)) AS DATE) AS order_date, 'ALL' AS customer_state, '{TARGET_CATEGORY}' AS product_category,
                 ROUND(GREATEST(mean, 0), 4) AS forecast_revenue, ROUND(GREATEST(mean - width, 0), 4) AS lower_revenue,
                 ROUND(GREATEST(mean + width, 0), 4) AS upper_revenue, 'ok' AS status
          FROM ahead)""",
)
# The same fold for all series at once, over lists: level, trend, squares, total and then the season.
oracle(
    "forecast_ets_values",
    """SELECT * FROM (
          WITH listed AS (
            SELECT customer_state, product_category, list(revenue ORDER BY order_date) AS y, MAX(order_date) AS last_date, COUNT(*) AS n
            FROM daily_series GROUP BY 1, 2 HAVING COUNT(*) >= 35),
          weeks AS (SELECT *, list_transform(range(n // 7), lambda w: list_sum(y[7 * w + 1 : 7 * w + 7]) / 7) AS m FROM listed),
          slopes AS (SELECT *, (m[-1] - m[1]) / (7 * (len(m) - 1)) AS slope FROM weeks),
          patterns AS (SELECT *, list_transform(range(7), lambda j: list_avg(list_transform(range(len(m)), lambda w: y[7 * w + j + 1] - m[w + 1] - slope * (j - 3)))) AS season FROM slopes),
          weights AS (SELECT row_number() OVER (ORDER BY a, b, g) AS i, a, b, g FROM
            (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]::DOUBLE[]) AS a), (SELECT unnest([0.0, 0.01, 0.05, 0.15]::DOUBLE[]) AS b),
            (SELECT unnest([0.0, 0.02, 0.05, 0.1, 0.25]::DOUBLE[]) AS g)),
          folded AS (
            SELECT customer_state, product_category, last_date, n, i, list_reduce(y, lambda s, v: list_concat(
              [s[1] + s[2] + a * (v - s[1] - s[2] - s[5]), s[2] + a * b * (v - s[1] - s[2] - s[5]), s[3] + (v - s[1] - s[2] - s[5]) * (v - s[1] - s[2] - s[5]), s[4] + (v - s[1] - s[2] - s[5])],
              s[6:11], [s[5] + g * (1 - a) * (v - s[1] - s[2] - s[5])]), list_concat([m[1] - slope * 4, slope, 0.0::DOUBLE, 0.0::DOUBLE], season)) AS s
            FROM patterns, weights),
          best AS (SELECT customer_state, product_category, last_date, n, arg_min(s, (s[3], i)) AS s FROM folded GROUP BY ALL),
          ahead AS (
            SELECT *, s[1] + h * s[2] + s[5 + (h - 1) % 7] AS mean, 1.2815515655446004::DOUBLE * sqrt((s[3] - s[4] * s[4] / n) / (n - 1)) * sqrt(h) AS width
            FROM best, generate_series(1, 30) AS t(h))
          SELECT CAST(last_date + to_days(CAST(h AS INT)) AS DATE) AS order_date, customer_state, product_category,
                 ROUND(GREATEST(mean, 0), 2) AS forecast_revenue, ROUND(GREATEST(mean - width, 0), 2) AS lower_revenue,
                 ROUND(GREATEST(mean + width, 0), 2) AS upper_revenue, 'ok' AS status
          FROM ahead
          UNION ALL SELECT NULL, customer_state, product_category, NULL, NULL, NULL, 'too short'
          FROM daily_series GROUP BY customer_state, product_category HAVING COUNT(*) < 35)""",
)
_SCOPED = f"FROM ma_forecast WHERE product_category = '{TARGET_CATEGORY}' AND customer_state"
oracle(
    "scope_forecast",
    f"""SELECT *, 'ok' AS status, 'state' AS scope {_SCOPED} = 'NATION_7'
        UNION ALL SELECT *, 'ok', 'all states' {_SCOPED} = 'ALL'
        UNION ALL SELECT *, 'ok', 'category table' {_SCOPED} = 'ALL'""",
)

# --- reports -------------------------------------------------------------------------------------


def _six(metric: str, value: str, source: str) -> str:
    return f"SELECT '{metric}' AS metric, printf('%.6f', {value}) AS value FROM {source}"


CTES["frame_confusion"] = """
    SELECT COUNT(*) FILTER (p AND a) AS tp, COUNT(*) FILTER (p AND NOT a) AS fp, COUNT(*) FILTER (NOT p AND a) AS fn,
           COUNT(*) FILTER (p = a) AS hits, COUNT(*) FILTER (a) AS positives, COUNT(*) AS total
    FROM (SELECT repeat_probability >= 0.5 AS p, repeat_purchase_label = 1 AS a FROM frame)"""
oracle(
    "executive_summary",
    _union(
        [
            _six("Repeat purchase accuracy", "hits / total", "frame_confusion"),
            _six("Repeat purchase precision", "tp / (tp + fp)", "frame_confusion"),
            _six("Repeat purchase recall", "tp / (tp + fn)", "frame_confusion"),
            _six("Repeat purchase f1", "2 * tp / (2 * tp + fp + fn)", "frame_confusion"),
            _six("Repeat purchase target_rate", "positives / total", "frame_confusion"),
            "SELECT 'Repeat purchase test_rows', CAST(total AS VARCHAR) FROM frame_confusion",
            "SELECT 'Experiment target_category_display', 'Watches gifts'",
            "SELECT 'Experiment customers', CAST(customers AS VARCHAR) FROM overview",
            _six("Experiment target_rate", "target_rate", "overview"),
            _six("Experiment average_outcome", "average_outcome", "overview"),
            _six("DIM estimate", "estimate", "welch"),
            _six("DIM p_value", "p", "welch"),
            "SELECT 'DIM is_significant_05', CASE WHEN p < 0.05 THEN 'true' ELSE 'false' END FROM welch",
            _six("R-learner estimate", "estimate", "segment_test"),
            _six("R-learner p_value", "p", "segment_test"),
            "SELECT 'R-learner is_significant_05', CASE WHEN p < 0.05 THEN 'true' ELSE 'false' END FROM segment_test",
        ]
    ),
)
oracle(
    "report_extracts",
    """SELECT customer_unique_id, first_customer_state, first_product_category, repeat_probability
       FROM scored""",
)

# --- shown digits --------------------------------------------------------------------------------

# Columns that hold sums of amounts or quotients of sums: both sides show four or six digits of them.
_SHOWN = {
    "revenue": [
        "category_daily_sales", "state_category_daily_sales", "daily_sales_round_trip", "monthly_refresh", "daily_revenue", "top_categories",
        "top_states", "state_category_mix", "state_category_rollup", "forecast_scope", "forecast_scope_choices",
        "daily_series", "rolling_residuals", "forecast_overlay",
    ],
    "payment_value": ["payment_summary", "fact_orders", "filtered_orders", "first_orders"],
    "item_revenue": ["item_summary", "fact_orders", "filtered_orders"],
    "freight_value": ["item_summary", "fact_orders", "filtered_orders"],
    "total_revenue": ["customer_features", "kpi_summary", "segment_names"],
    "avg_order_value": ["customer_features", "kpi_summary", "segment_names"],
    "late_delivery_rate": ["customer_features", "kpi_summary"],
    "first_order_value": ["customer_repeat_features", "impute_median", "experiment_frame"],
    "first_freight_value": ["customer_repeat_features", "impute_median"],
    "order_value": ["ab_test_sample"],
}
_QUOTIENTS = {"avg_order_value", "late_delivery_rate"}
for _name in ORACLES:
    _columns = {column: 6 if column in _QUOTIENTS else 4 for column, names in _SHOWN.items() if _name in names}
    if _columns:
        _rounds = ", ".join(f"ROUND({column}, {digits}) AS {column}" for column, digits in _columns.items())
        ORACLES[_name] = f"SELECT * REPLACE ({_rounds}) FROM ({ORACLES[_name]})"
