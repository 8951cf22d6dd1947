from tessera.operators import report as R
from tessera.operators import sales as S
from tessera.sources.sales import schema_catalog
from tests.fixtures import customers5, empty_orders, products8, sales_gaps


def test_products8_inventory_and_categories(spark):
    p = products8(spark)
    inv = S.inventory_stats(p).collect()[0]
    assert (inv.total_units, inv.avg_stock, inv.min_stock, inv.max_stock) == (725, 90.625, 30, 200)
    low = S.low_stock(p).collect()
    assert [(r.name, r.stock_quantity) for r in low] == [("gimlet", 30)]  # 50 is not < 50
    cats = {r.category: r.product_count for r in S.products_per_category(p).collect()}
    assert cats == {"Electronics": 3, "Kitchen": 2, "Clothing": 1, "Sports": 1, "Footwear": 1}


def test_customers5_states(spark):
    st = S.customers_per_state(customers5(spark)).collect()
    assert sorted((r.state, r.customer_count) for r in st) == [("AZ", 1), ("CA", 1), ("IL", 1), ("NY", 1), ("TX", 1)]
    assert S.customer_count(customers5(spark)).collect()[0].customer_count == 5


def test_left_joins_keep_gaps(spark):
    t = sales_gaps(spark)
    cos = {r.customer_id: (r.order_count, r.total_spent)
           for r in S.customer_orders_summary(t["customers"], t["orders"]).collect()}
    assert cos == {1: (2, 50.0), 2: (1, 35.0), 3: (0, None)}
    pss = S.product_sales_summary(t["products"], t["order_items"]).collect()
    assert [r.product_id for r in pss] == [1, 2, 3, 4]  # 40 = 40 tie broken by id, NULL last
    assert (pss[-1].units_sold, pss[-1].revenue) == (None, None)


def test_top_products_tie_break_and_rank(spark):
    t = sales_gaps(spark)
    top = S.top_products(t["products"], t["order_items"], k=2).collect()
    assert [(r.rank, r.product_id, r.revenue) for r in top] == [(1, 1, 40.0), (2, 2, 40.0)]


def test_customer_name_null_and_top_customers(spark):
    t = sales_gaps(spark)
    tc = S.top_customers(t["customers"], t["orders"]).collect()
    assert [(r.customer_id, r.customer_name, r.order_count, r.total_spent, r.avg_order_value) for r in tc] == [
        (1, "Ann Lee", 2, 50.0, 25.0), (2, None, 1, 35.0, 35.0)]


def test_status_and_payment(spark):
    t = sales_gaps(spark)
    sb = [(r.status, r.order_count, r.total_amount, r.avg_amount) for r in S.status_breakdown(t["orders"]).collect()]
    assert sb == [("Shipped", 2, 50.0, 25.0), ("Pending", 1, 35.0, 35.0)]
    pb = {r.payment_method: (r.order_count, r.percent_of_orders) for r in S.payment_breakdown(t["orders"]).collect()}
    assert pb["PayPal"][0] == 2 and abs(pb["PayPal"][1] - 200 / 3) < 1e-9


def test_reconciliation_and_order_totals(spark):
    t = sales_gaps(spark)
    ot = {r.order_id: r.order_total for r in S.order_totals(t["order_items"]).collect()}
    assert ot == {10: 40.0, 11: 35.0, 12: 20.0}
    rec = S.order_total_reconciliation(t["orders"], t["order_items"]).collect()
    assert [(r.order_id, r.issue) for r in rec] == [(12, "mismatch")]


def test_empty_orders(spark):
    t = empty_orders(spark)
    a1 = S.sales_totals(t["orders"]).collect()[0]
    assert (a1.order_count, a1.total_revenue, a1.avg_order_value) == (0, None, None)
    assert S.status_breakdown(t["orders"]).count() == 0
    lines = [r.line for r in R.sales_report_lines(t, generated_on="X").orderBy(
        "section", "part", "line_no", "tiebreak").collect()]
    assert "Total Orders: 0" in lines and "Total Revenue: $n/a" in lines and "Average Order Value: $n/a" in lines


def test_report_text_layout(spark, tmp_path):
    import glob
    t = sales_gaps(spark)
    t["products"] = products8(spark)
    out = str(tmp_path / "report")
    R.write_report_text(R.sales_report_lines(t, generated_on="2024-01-01 00:00:00"), out)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{out}/part-*"))).removesuffix("\n")
    lines = text.split("\n")
    assert lines[0] == "=" * 80 and lines[2] == "Generated on: 2024-01-01 00:00:00"
    assert "\nLow Stock Products (less than 50 units):\n  gimlet (Sports): 30 units left | $2.40" in text
    assert "  PayPal: 2 orders (66.7%)" in text
    assert "  None: 1 customers" in text  # NULL state prints like Python


def test_low_stock_block_omitted(spark):
    t = sales_gaps(spark)
    lines = [r.line for r in R.sales_report_lines(t, generated_on="X", low_stock_threshold=1).collect()]
    assert not any("Low Stock" in line for line in lines)


def test_schema_catalog_keys(spark):
    t = sales_gaps(spark)
    cat = {(r.table_name, r.column_name): r for r in schema_catalog(t).collect()}
    assert cat[("customers", "customer_id")].is_key and cat[("customers", "customer_id")].key_holds
    assert cat[("customers", "state")].nulls == 1 and cat[("customers", "state")].key_holds is None


def test_shipping_and_price_lookup(spark):
    t = sales_gaps(spark)
    sa = {r.order_id: r.shipping_address for r in S.with_shipping_address(t["orders"], t["customers"]).collect()}
    assert sa[10] == "1 A St, Town, NY 1" and sa[11] is None  # NULL state propagates
    pl = S.price_lookup(t["order_items"], t["products"]).collect()
    assert all(r.list_price is not None for r in pl)


def test_report_line_count(spark):
    t = sales_gaps(spark)
    lines = R.sales_report_lines(t, generated_on="X").collect()
    n_status, n_cat, n_states, n_pay = 2, 2, 2, 2
    n_top_p, n_top_c = 3, 2          # products sold (product 4 never is), customers with orders
    n_low = 4                        # stock < 50: 5, 10, 49 (+ heading)
    expected = (4 + 5 + 1 + n_status + 3 + n_cat + 1 + 2 * n_top_p + 1 + n_cat + 3 + 1 + 2 * n_top_c
                + 1 + n_states + 5 + n_low + 3 + 2 * n_pay)
    assert len(lines) == expected
