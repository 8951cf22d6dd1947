"""DuckDB SQL for schema catalog, data-quality and listing queries."""

from oracle.sales_sql import with_adapter

# Logical schema (declared types) used by the catalog check.
LOGICAL = {
    "customers": [("customer_id", "bigint"), ("first_name", "string"), ("last_name", "string"),
                  ("email", "string"), ("address", "string"), ("city", "string"), ("state", "string"),
                  ("zipcode", "string"), ("registration_date", "date"), ("last_login", "date")],
    "products": [("product_id", "bigint"), ("name", "string"), ("description", "string"),
                 ("category", "string"), ("price", "decimal(18,2)"), ("stock_quantity", "bigint"),
                 ("created_date", "date")],
    "sales_orders": [("order_id", "bigint"), ("customer_id", "bigint"), ("order_date", "date"),
                     ("total_amount", "decimal(18,2)"), ("status", "string"), ("shipping_address", "string"),
                     ("payment_method", "string")],
    "order_items": [("order_item_id", "bigint"), ("order_id", "bigint"), ("product_id", "bigint"),
                    ("quantity", "bigint"), ("price_per_unit", "decimal(18,2)")],
}
KEYS = {"customers": "customer_id", "products": "product_id", "sales_orders": "order_id",
        "order_items": "order_item_id"}
NAMES = {"sales_orders": "orders"}
# columns that the adapter leaves empty (no driver source)
EMPTY = {("customers", "registration_date"), ("customers", "last_login"),
         ("products", "created_date"), ("sales_orders", "shipping_address")}

NOT_NULL = {
    "customers": ["first_name", "last_name", "email", "registration_date"],
    "products": ["name", "category", "price", "stock_quantity", "created_date"],
    "sales_orders": ["customer_id", "order_date", "total_amount", "status"],
    "order_items": ["order_id", "product_id", "quantity", "price_per_unit"],
}


def _col(t, c):
    return "NULL" if (t, c) in EMPTY else c


def catalog_sql() -> str:
    sel = []
    for t, cols in LOGICAL.items():
        key = KEYS[t]
        for i, (c, ty) in enumerate(cols):
            is_key = "true" if c == key else "false"
            holds = (f"(COUNT(*) FILTER (WHERE {c} IS NULL) = 0 AND COUNT(DISTINCT {c}) = COUNT(*))"
                     if c == key else "CAST(NULL AS BOOLEAN)")
            sel.append(f"SELECT '{NAMES.get(t, t)}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, "
                       f"'{ty}' AS data_type, {is_key} AS is_key, COUNT(*) AS row_count, "
                       f"COUNT(*) FILTER (WHERE {_col(t, c)} IS NULL) AS nulls, {holds} AS key_holds FROM {t}")
    return with_adapter("\nUNION ALL\n".join(sel))


def null_violations_sql() -> str:
    sel = []
    for t, cols in NOT_NULL.items():
        for c in cols:
            sel.append(f"SELECT '{NAMES.get(t, t)}' AS table_name, '{c}' AS column_name, "
                       f"COUNT(*) FILTER (WHERE {_col(t, c)} IS NULL) AS null_count FROM {t}")
    return with_adapter("\nUNION ALL\n".join(sel))


KEYS_CTE = r"""
page_keys AS (
  SELECT regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS key FROM pages)"""

def keys_sql() -> str:
    parts = []
    for table, cols in LOGICAL.items():
        for i, (c, _) in enumerate(cols):
            col = "CAST(NULL AS INTEGER)" if (table, c) in EMPTY else c
            parts.append(f"""SELECT '{NAMES.get(table, table)}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, COUNT(*) AS row_count,
  COUNT(*) - COUNT({col}) AS nulls, COUNT(*) > 0 AND COUNT({col}) = COUNT(*) AND COUNT(DISTINCT {col}) = COUNT(*) AS is_key FROM {table}""")
    return with_adapter("\nUNION ALL\n".join(parts))


SQL = {
    "discovered_keys": keys_sql(),
    "schema_catalog": catalog_sql(),
    "null_violations": null_violations_sql(),
    "duplicate_order_items": with_adapter("""
SELECT order_item_id, COUNT(*) AS dup_count FROM order_items GROUP BY order_item_id HAVING COUNT(*) > 1"""),
    "orphan_counts": with_adapter("""
SELECT 'orders.customer_id' AS foreign_key, COUNT(*) AS orphan_count FROM sales_orders o
  WHERE o.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = o.customer_id)
UNION ALL
SELECT 'order_items.order_id', COUNT(*) FROM order_items i
  WHERE i.order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sales_orders o WHERE o.order_id = i.order_id)
UNION ALL
SELECT 'order_items.product_id', COUNT(*) FROM order_items i
  WHERE i.product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)"""),
    "orders_without_items": with_adapter("""
SELECT o.order_id, o.customer_id, o.order_date, o.total_amount, o.status, o.payment_method
FROM sales_orders o WHERE NOT EXISTS (SELECT 1 FROM order_items i WHERE i.order_id = o.order_id)"""),
    "append_customers": with_adapter("""
batch AS (
  SELECT first_name, last_name, email, state FROM customers
  UNION ALL
  SELECT split_part(s.s_name, '#', 1), substr(s.s_name, instr(s.s_name, '#') + 1),
         lower(s.s_name) || '@example.com', n.n_name
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
grouped AS (SELECT first_name, last_name, email, state, COUNT(*) AS copies FROM batch GROUP BY ALL),
ranked AS (
  SELECT g.*, row_number() OVER (PARTITION BY email ORDER BY first_name, last_name, state) = 1
              AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.email = g.email) AS kept
  FROM grouped g),
mx AS (SELECT COALESCE(MAX(customer_id), 0) AS m FROM customers)
SELECT first_name, last_name, email, state,
       CAST(mx.m + row_number() OVER (ORDER BY email) AS BIGINT) AS customer_id,
       'inserted' AS outcome, CAST(1 AS BIGINT) AS copies
FROM ranked, mx WHERE kept
UNION ALL
SELECT first_name, last_name, email, state, CAST(NULL AS BIGINT), 'rejected',
       CASE WHEN kept THEN copies - 1 ELSE copies END
FROM ranked WHERE (CASE WHEN kept THEN copies - 1 ELSE copies END) > 0"""),
    "folders": "WITH" + KEYS_CTE + """
SELECT DISTINCT regexp_extract(key, '^(.*/)[^/]*$', 1) AS folder FROM page_keys
WHERE regexp_extract(key, '^(.*/)[^/]*$', 1) <> '' ORDER BY folder""",
    "files": "WITH" + KEYS_CTE + """
SELECT key AS file FROM page_keys WHERE NOT suffix(key, '/') ORDER BY file""",
    "listing_lines": "WITH" + KEYS_CTE + """
SELECT 0 AS part, '' AS sort_key, 'Folders:' AS line
UNION ALL SELECT 2, '', chr(10) || 'Files:'
UNION ALL SELECT DISTINCT 1, f, '  - ' || f FROM (SELECT regexp_extract(key, '^(.*/)[^/]*$', 1) AS f FROM page_keys) WHERE f <> ''
UNION ALL SELECT 3, key, '  - ' || key FROM page_keys WHERE NOT suffix(key, '/')""",
    "supported_files": "WITH" + KEYS_CTE + """
SELECT key, (lower(key) LIKE '%.txt' OR lower(key) LIKE '%.md' OR lower(key) LIKE '%.csv'
             OR lower(key) LIKE '%.log' OR lower(key) LIKE '%.pdf') AS supported,
       CASE WHEN (lower(key) LIKE '%.txt' OR lower(key) LIKE '%.md' OR lower(key) LIKE '%.csv'
             OR lower(key) LIKE '%.log' OR lower(key) LIKE '%.pdf') THEN 'Supported' ELSE 'Skipped' END AS status
FROM page_keys""",
}
