"""DuckDB SQL for the sales operators, written from the operator semantics.

The adapter CTEs mirror FIXTURES.md section 2 (driver tables -> logical
sales schema)."""

ADAPTER = """
customers AS (
  SELECT c.c_custkey AS customer_id,
         split_part(c.c_name, '#', 1) AS first_name,
         substr(c.c_name, instr(c.c_name, '#') + 1) AS last_name,
         lower(c.c_name) || '@example.com' AS email,
         c.c_name AS address, c.c_mktsegment AS city, n.n_name AS state,
         CAST(c.c_custkey AS VARCHAR) AS zipcode
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_brand AS description, p_type AS category,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_size AS BIGINT) AS stock_quantity
  FROM part),
sales_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderstatus AS status,
         o_orderpriority AS payment_method
  FROM orders),
order_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
         l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price_per_unit
  FROM lineitem)
"""


def with_adapter(body: str) -> str:
    return "WITH " + ADAPTER.strip() + ",\n" + body.strip()


# ROUND(sum / n, 2) half-up computed in integers (exact, no binary floats).
def _avg2(sum_expr: str, n_expr: str) -> str:
    return (f"CAST((2 * CAST(({sum_expr}) * 100 AS HUGEINT) + ({n_expr})) // (2 * ({n_expr})) AS DOUBLE) / 100")


ITEM_AGG = """item_agg AS (
  SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units_sold,
         SUM(quantity * price_per_unit) AS revenue
  FROM order_items GROUP BY product_id)"""

ORDER_AGG = """order_agg AS (
  SELECT customer_id, COUNT(order_id) AS order_count, SUM(total_amount) AS spent
  FROM sales_orders GROUP BY customer_id)"""

SQL = {
    "product_sales_summary": with_adapter(ITEM_AGG + """
SELECT p.product_id, p.name, p.category, CAST(p.price AS DOUBLE) AS price,
       a.units_sold, CAST(a.revenue AS DOUBLE) AS revenue
FROM products p LEFT JOIN item_agg a ON p.product_id = a.product_id
ORDER BY a.revenue DESC NULLS LAST, p.product_id"""),

    "table_dump": with_adapter("""
SELECT product_id, name, description, category, price, stock_quantity, CAST(NULL AS DATE) AS created_date
FROM products"""),

    "low_stock": with_adapter("""
SELECT product_id, name, category, stock_quantity, CAST(price AS DOUBLE) AS price
FROM products WHERE stock_quantity < 10 ORDER BY stock_quantity, product_id"""),

    "shipping_address": with_adapter("""
SELECT o.order_id, o.customer_id, o.order_date, CAST(o.total_amount AS DOUBLE) AS total_amount,
       o.status, c.address || ', ' || c.city || ', ' || c.state || ' ' || c.zipcode AS shipping_address,
       o.payment_method
FROM sales_orders o LEFT JOIN customers c ON o.customer_id = c.customer_id"""),

    "top_products": with_adapter(ITEM_AGG + """
SELECT a.product_id, p.name, p.category, CAST(p.price AS DOUBLE) AS price, a.units_sold,
       CAST(a.revenue AS DOUBLE) AS revenue,
       CAST(row_number() OVER (ORDER BY a.revenue DESC, a.product_id) AS INTEGER) AS rank
FROM item_agg a JOIN products p ON p.product_id = a.product_id
ORDER BY a.revenue DESC, a.product_id LIMIT 5"""),

    "category_sales": with_adapter("""
SELECT p.category, CAST(SUM(i.quantity) AS BIGINT) AS units_sold,
       CAST(SUM(i.quantity * i.price_per_unit) AS DOUBLE) AS revenue
FROM order_items i JOIN products p ON i.product_id = p.product_id
GROUP BY p.category ORDER BY SUM(i.quantity * i.price_per_unit) DESC, p.category"""),

    "top_customers": with_adapter(ORDER_AGG + """
SELECT a.customer_id, c.first_name || ' ' || c.last_name AS customer_name, a.order_count,
       CAST(a.spent AS DOUBLE) AS total_spent,
       CAST(a.spent AS DOUBLE) / CAST(a.order_count AS DOUBLE) AS avg_order_value,
       CAST(row_number() OVER (ORDER BY a.spent DESC, a.customer_id) AS INTEGER) AS rank
FROM order_agg a JOIN customers c ON c.customer_id = a.customer_id
ORDER BY a.spent DESC, a.customer_id LIMIT 5"""),

    "customer_orders_summary": with_adapter(ORDER_AGG + """
SELECT c.customer_id, c.first_name, c.last_name, c.email,
       COALESCE(a.order_count, 0) AS order_count, CAST(a.spent AS DOUBLE) AS total_spent
FROM customers c LEFT JOIN order_agg a ON c.customer_id = a.customer_id"""),

    "price_lookup": with_adapter("""
SELECT i.order_item_id, i.order_id, i.product_id, i.quantity,
       CAST(i.price_per_unit AS DOUBLE) AS price_per_unit, CAST(p.price AS DOUBLE) AS list_price
FROM order_items i LEFT JOIN products p ON i.product_id = p.product_id"""),

    "sales_totals": with_adapter("""
SELECT COUNT(*) AS order_count, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(total_amount) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS avg_order_value
FROM sales_orders"""),

    "status_breakdown": with_adapter(f"""
SELECT status, COUNT(*) AS order_count, CAST(SUM(total_amount) AS DOUBLE) AS total_amount,
       {_avg2('SUM(total_amount)', 'COUNT(*)')} AS avg_amount
FROM sales_orders GROUP BY status ORDER BY order_count DESC, status"""),

    "products_per_category": with_adapter("""
SELECT category, COUNT(*) AS product_count FROM products
GROUP BY category ORDER BY product_count DESC, category"""),

    "customer_count": with_adapter("SELECT COUNT(*) AS customer_count FROM customers"),

    "customers_per_state": with_adapter("""
SELECT state, COUNT(*) AS customer_count FROM customers
GROUP BY state ORDER BY customer_count DESC, state NULLS LAST"""),

    "inventory_stats": with_adapter("""
SELECT CAST(SUM(stock_quantity) AS BIGINT) AS total_units,
       CAST(SUM(stock_quantity) AS DOUBLE) / CAST(COUNT(stock_quantity) AS DOUBLE) AS avg_stock,
       MIN(stock_quantity) AS min_stock, MAX(stock_quantity) AS max_stock
FROM products"""),

    "payment_breakdown": with_adapter("""
SELECT payment_method, COUNT(*) AS order_count, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(total_amount) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS avg_order_value,
       100.0::DOUBLE * CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS percent_of_orders
FROM sales_orders GROUP BY payment_method ORDER BY SUM(total_amount) DESC, payment_method"""),

    "order_totals": with_adapter("""
SELECT order_id, CAST(SUM(quantity * price_per_unit) AS DOUBLE) AS order_total
FROM order_items GROUP BY order_id"""),

    "order_total_reconciliation": with_adapter("""
SELECT o.order_id, CAST(o.total_amount AS DOUBLE) AS total_amount,
       CAST(s.items AS DOUBLE) AS items_total,
       CASE WHEN s.items IS NULL THEN 'no_items' ELSE 'mismatch' END AS issue
FROM sales_orders o
LEFT JOIN (SELECT order_id, SUM(quantity * price_per_unit) AS items FROM order_items GROUP BY order_id) s
  ON o.order_id = s.order_id
WHERE s.items IS NULL OR s.items <> o.total_amount"""),
}
