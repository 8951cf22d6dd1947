"""Hand-written fixtures (FIXTURES.md section 3)."""

from decimal import Decimal

CUSTOMER_SCHEMA = ("customer_id bigint, first_name string, last_name string, email string, address string, "
                   "city string, state string, zipcode string, registration_date date, last_login date")
PRODUCT_SCHEMA = ("product_id bigint, name string, description string, category string, price decimal(18,2), "
                  "stock_quantity bigint, created_date date")
ORDER_SCHEMA = ("order_id bigint, customer_id bigint, order_date date, total_amount decimal(18,2), status string, "
                "shipping_address string, payment_method string")
ITEM_SCHEMA = "order_item_id bigint, order_id bigint, product_id bigint, quantity bigint, price_per_unit decimal(18,2)"

# Eight products: 725 units in all, one stock below 50 and one at 50.
PRODUCTS8 = [
    ("anvil", "Electronics", "8.50", 120),
    ("bellows", "Kitchen", "12.00", 50),
    ("chisel", "Electronics", "3.25", 90),
    ("drill", "Clothing", "40.00", 60),
    ("easel", "Electronics", "27.75", 200),
    ("flask", "Kitchen", "6.10", 75),
    ("gimlet", "Sports", "2.40", 30),
    ("hammer", "Footwear", "15.00", 100),
]

CUSTOMERS5 = [
    ("Ada", "North", "ada@shop.example", "1 Elm", "Aville", "NY", "1"),
    ("Ben", "South", "ben@shop.example", "2 Elm", "Bville", "CA", "2"),
    ("Cleo", "East", "cleo@shop.example", "3 Elm", "Cville", "IL", "3"),
    ("Dov", "West", "dov@shop.example", "4 Elm", "Dville", "TX", "4"),
    ("Eve", "Mid", "eve@shop.example", "5 Elm", "Eville", "AZ", "5"),
]


def products8(spark):
    rows = [(i + 1, n, None, c, Decimal(p), s, None) for i, (n, c, p, s) in enumerate(PRODUCTS8)]
    return spark.createDataFrame(rows, PRODUCT_SCHEMA)


def customers5(spark):
    rows = [(i + 1, *r, None, None) for i, r in enumerate(CUSTOMERS5)]
    return spark.createDataFrame(rows, CUSTOMER_SCHEMA)


def sales_gaps(spark):
    """Customer 3 has no orders, product 4 is never sold, customer 2 has a
    NULL state and a NULL last name, products 1 and 2 have equal revenue."""
    customers = spark.createDataFrame([
        (1, "Ann", "Lee", "ann@x", "1 A St", "Town", "NY", "1", None, None),
        (2, "Bob", None, "bob@x", "2 B St", "City", None, "2", None, None),
        (3, "Cid", "Roe", "cid@x", "3 C St", "Town", "NY", "3", None, None),
    ], CUSTOMER_SCHEMA)
    products = spark.createDataFrame([
        (1, "P1", None, "A", Decimal("10.00"), 5, None),
        (2, "P2", None, "A", Decimal("20.00"), 60, None),
        (3, "P3", None, "B", Decimal("5.00"), 10, None),
        (4, "P4", None, "B", Decimal("7.50"), 49, None),
    ], PRODUCT_SCHEMA)
    orders = spark.createDataFrame([
        (10, 1, None, Decimal("40.00"), "Shipped", None, "PayPal"),
        (11, 2, None, Decimal("35.00"), "Pending", None, "Credit Card"),
        (12, 1, None, Decimal("10.00"), "Shipped", None, "PayPal"),
    ], ORDER_SCHEMA)
    items = spark.createDataFrame([
        (1, 10, 1, 2, Decimal("10.00")),
        (2, 10, 2, 1, Decimal("20.00")),
        (3, 11, 3, 3, Decimal("5.00")),
        (4, 11, 1, 2, Decimal("10.00")),
        (5, 12, 2, 1, Decimal("20.00")),
    ], ITEM_SCHEMA)
    return {"customers": customers, "products": products, "orders": orders, "order_items": items}


def empty_orders(spark):
    t = sales_gaps(spark)
    t["orders"] = spark.createDataFrame([], ORDER_SCHEMA)
    t["order_items"] = spark.createDataFrame([], ITEM_SCHEMA)
    return t


KEYS = ["a/b/c.txt", "a/b/", "root.txt", "a/b/d.PDF", "a/x.bin", "a/b/c.txt"]


def keys(spark):
    return spark.createDataFrame([(k,) for k in KEYS], "key string")


def col_values(df, col):
    return [r[col] for r in df.select(col).collect()]

