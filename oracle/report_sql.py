"""DuckDB SQL for the R1 report lines (registered with a fixed stamp and the
driver low-stock threshold)."""

from oracle.sales_sql import with_adapter


def _cents_avg(tot: str, n: str) -> str:
    # round(tot / n, 2) half-up, as integer cents
    return f"((2 * CAST(({tot}) * 100 AS HUGEINT) + ({n})) // (2 * ({n})))"


def _fmt_cents(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(38,0)) * 0.01 AS VARCHAR)"


def _fmt2(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR)"


def report_sql(stamp: str, threshold: int, k: int = 5) -> str:
    L = "SELECT {s} AS section, {p} AS part, CAST({n} AS BIGINT) AS line_no, CAST(0 AS BIGINT) AS tiebreak, {t} AS line"
    fixed = []

    def fx(s, p, n, t):
        fixed.append(L.format(s=s, p=p, n=n, t="'" + t.replace("'", "''") + "'"))
    nl = "' || chr(10) || '"
    fx(0, 0, 1, "=" * 80)
    fx(0, 0, 2, "ONLINE SALES DATABASE ANALYSIS REPORT")
    fx(0, 0, 3, "Generated on: " + stamp)
    fx(0, 0, 4, "=" * 80)
    body = f"""
ost AS (SELECT status, COUNT(*) AS n, SUM(total_amount) AS tot FROM sales_orders GROUP BY status),
opm AS (SELECT payment_method, COUNT(*) AS n, SUM(total_amount) AS tot FROM sales_orders GROUP BY payment_method),
otot AS (SELECT COALESCE(SUM(n), 0) AS n, SUM(tot) AS tot FROM ost),
pcat AS (SELECT category, COUNT(*) AS n FROM products GROUP BY category),
inv AS (SELECT SUM(stock_quantity) AS s, COUNT(stock_quantity) AS c, MIN(stock_quantity) AS mn, MAX(stock_quantity) AS mx FROM products),
ia AS (SELECT product_id, SUM(quantity) AS units, SUM(quantity * price_per_unit) AS rev FROM order_items GROUP BY product_id),
tp AS (SELECT p.name, p.category, p.price, ia.units, ia.rev,
              row_number() OVER (ORDER BY ia.rev DESC, ia.product_id) AS r
       FROM ia JOIN products p ON p.product_id = ia.product_id ORDER BY ia.rev DESC, ia.product_id LIMIT {k}),
csales AS (SELECT p.category, SUM(ia.units) AS units, SUM(ia.rev) AS rev FROM ia JOIN products p ON p.product_id = ia.product_id GROUP BY p.category),
oa AS (SELECT customer_id, COUNT(order_id) AS n, SUM(total_amount) AS tot FROM sales_orders GROUP BY customer_id),
tc AS (SELECT c.first_name || ' ' || c.last_name AS name, oa.n, oa.tot,
              row_number() OVER (ORDER BY oa.tot DESC, oa.customer_id) AS r
       FROM oa JOIN customers c ON c.customer_id = oa.customer_id ORDER BY oa.tot DESC, oa.customer_id LIMIT {k}),
cst AS (SELECT state, COUNT(*) AS n FROM customers GROUP BY state),
low AS (SELECT product_id, name, category, stock_quantity, price FROM products WHERE stock_quantity < {threshold})
"""
    sel = []
    sel += fixed
    fx2 = []

    def fxs(s, p, n, t):
        fx2.append(L.format(s=s, p=p, n=n, t="'" + t.replace("'", "''").replace("\n", nl) + "'"))
    fxs(1, 0, 1, "\n1. OVERALL SALES SUMMARY"); fxs(1, 0, 2, "-" * 30)
    fxs(1, 1, 0, "\nOrder Status Breakdown:")
    fxs(2, 0, 1, "\n\n2. PRODUCT ANALYSIS"); fxs(2, 0, 2, "-" * 30); fxs(2, 0, 3, "Product Categories:")
    fxs(2, 2, 0, f"\nTop {k} Products by Revenue:"); fxs(2, 3, 0, "\nSales by Category:")
    fxs(3, 0, 1, "\n\n3. CUSTOMER ANALYSIS"); fxs(3, 0, 2, "-" * 30)
    fxs(3, 1, 0, f"\nTop {k} Customers by Spending:"); fxs(3, 2, 0, "\nCustomer Distribution by State:")
    fxs(4, 0, 1, "\n\n4. INVENTORY STATUS"); fxs(4, 0, 2, "-" * 30)
    fxs(5, 0, 1, "\n\n5. PAYMENT METHOD ANALYSIS"); fxs(5, 0, 2, "-" * 30); fxs(5, 0, 3, "Payment Method Breakdown:")
    sel += fx2
    sel += [
        f"SELECT 1, 0, 3, 0, 'Total Orders: ' || CAST(n AS VARCHAR) FROM otot",
        f"SELECT 1, 0, 4, 0, 'Total Revenue: $' || COALESCE({_fmt2('tot')}, 'n/a') FROM otot",
        f"SELECT 1, 0, 5, 0, 'Average Order Value: $' || COALESCE(CASE WHEN n > 0 THEN {_fmt_cents(_cents_avg('tot', 'n'))} END, 'n/a') FROM otot",
        f"""SELECT 1, 1, row_number() OVER (ORDER BY n DESC, status NULLS LAST), 0,
              '  ' || COALESCE(status, 'None') || ': ' || CAST(n AS VARCHAR) || ' orders, $' || {_fmt2('tot')}
              || ' total, $' || {_fmt_cents(_cents_avg('tot', 'n'))} || ' avg' FROM ost""",
        f"""SELECT 2, 1, row_number() OVER (ORDER BY n DESC, category NULLS LAST), 0,
              '  ' || COALESCE(category, 'None') || ': ' || CAST(n AS VARCHAR) || ' products' FROM pcat""",
        f"SELECT 2, 2, 2 * r - 1, 0, '  ' || CAST(r AS VARCHAR) || '. ' || COALESCE(name, 'None') || ' (' || COALESCE(category, 'None') || ')' FROM tp",
        f"""SELECT 2, 2, 2 * r, 0, '     Price: $' || {_fmt2('price')} || ' | Units Sold: ' || CAST(units AS VARCHAR)
              || ' | Revenue: $' || {_fmt2('rev')} FROM tp""",
        f"""SELECT 2, 3, row_number() OVER (ORDER BY rev DESC, category NULLS LAST), 0,
              '  ' || COALESCE(category, 'None') || ': ' || CAST(units AS VARCHAR) || ' units, $' || {_fmt2('rev')} || ' revenue' FROM csales""",
        f"SELECT 3, 0, 3, 0, 'Total Customers: ' || CAST(COALESCE(SUM(n), 0) AS VARCHAR) FROM cst",
        f"SELECT 3, 1, 2 * r - 1, 0, '  ' || CAST(r AS VARCHAR) || '. ' || COALESCE(name, 'None') FROM tc",
        f"""SELECT 3, 1, 2 * r, 0, '     Orders: ' || CAST(n AS VARCHAR) || ' | Total Spent: $' || {_fmt2('tot')}
              || ' | Avg Order: $' || {_fmt_cents(_cents_avg('tot', 'n'))} FROM tc""",
        f"""SELECT 3, 2, row_number() OVER (ORDER BY n DESC, state NULLS LAST), 0,
              '  ' || COALESCE(state, 'None') || ': ' || CAST(n AS VARCHAR) || ' customers' FROM cst""",
        "SELECT 4, 0, 3, 0, 'Total Inventory: ' || COALESCE(CAST(s AS VARCHAR), 'n/a') || ' units' FROM inv",
        """SELECT 4, 0, 4, 0, 'Average Stock per Product: ' || COALESCE(CASE WHEN c > 0 THEN
              CAST(CAST((2 * CAST(s AS HUGEINT) * 10 + c) // (2 * c) AS DECIMAL(38,0)) * 0.1 AS VARCHAR) END, 'n/a') || ' units' FROM inv""",
        "SELECT 4, 0, 5, 0, 'Stock Range: ' || COALESCE(CAST(mn AS VARCHAR), 'n/a') || ' to ' || COALESCE(CAST(mx AS VARCHAR), 'n/a') || ' units' FROM inv",
        f"SELECT 4, 1, 1, 0, chr(10) || 'Low Stock Products (less than {threshold} units):' FROM low HAVING COUNT(*) > 0",
        f"""SELECT 4, 2, stock_quantity, product_id, '  ' || COALESCE(name, 'None') || ' (' || COALESCE(category, 'None') || '): '
              || CAST(stock_quantity AS VARCHAR) || ' units left | $' || {_fmt2('price')} FROM low""",
        f"""SELECT 5, 1, 2 * row_number() OVER (ORDER BY tot DESC, payment_method NULLS LAST) - 1, 0,
              '  ' || COALESCE(payment_method, 'None') || ': ' || CAST(n AS VARCHAR) || ' orders ('
              || CAST(CAST((2 * 1000 * CAST(n AS HUGEINT) + SUM(n) OVER ()) // (2 * SUM(n) OVER ()) AS DECIMAL(38,0)) * 0.1 AS VARCHAR) || '%)' FROM opm""",
        f"""SELECT 5, 1, 2 * row_number() OVER (ORDER BY tot DESC, payment_method NULLS LAST), 0,
              '     Total Revenue: $' || {_fmt2('tot')} || ' | Avg Order: $' || {_fmt_cents(_cents_avg('tot', 'n'))} FROM opm""",
    ]
    return with_adapter(body.strip() + "\n" + "\nUNION ALL\n".join(sel))
