"""Synthetic orders and order items for given customers and products,
seeded (the reference draws unseeded random numbers per customer and order
in a Python loop).

Per customer 1-3 orders; per order 1-5 distinct products (never more than
there are products), quantity 1-3, a date in January-March 2024 on day
1-28, a status and a payment method; the order total is the sum of
price x quantity of its items. Everything is a deterministic function of
(seed, ids) computed with ``xxhash64``, so a re-run or a recomputed task
gives the same rows. Distinct products per order are consecutive positions
(mod the product count) from a hashed start, joined to the products by
position; products are numbered by a range partitioning, not a single-task
window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference's generator.
STATUSES = ["Pending", "Shipped", "Delivered", "Cancelled"]
PAYMENTS = ["Credit Card", "PayPal", "Apple Pay", "Google Pay"]


def _u(seed: int, *cols, salt: str) -> F.Column:
    """Non-negative pseudo-random long from (seed, salt, cols)."""
    return F.abs(F.xxhash64(F.lit(seed), F.lit(salt), *cols) % F.lit(1 << 40))


def _pick(values: list[str], u: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (u % len(values) + 1).cast("int"))


def _number_products(products: DataFrame) -> DataFrame:
    """Dense position 0..P-1 by product_id without a global single-task
    window: range-partition, count per partition, add offsets."""
    ranged = products.select("product_id", "price").repartitionByRange("product_id") \
        .sortWithinPartitions("product_id")
    numbered = ranged.select("*", F.spark_partition_id().alias("__pid"),
                             F.monotonically_increasing_id().alias("__mid"))
    counts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select("__pid", (F.sum("__cnt").over(Window.orderBy("__pid")) - F.col("__cnt")).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return numbered.join(F.broadcast(offsets), "__pid").select(
        "product_id", "price", (F.col("__off") + local).alias("pos"))


def generate_sales(customers: DataFrame, products: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    n_products = products.agg(F.count(F.lit(1))).scalar()
    c = customers.select("customer_id", "address", "city", "state", "zipcode")
    orders = c.select("*", F.explode(F.sequence(F.lit(1), (_u(seed, "customer_id", salt="n_orders") % 3 + 1)
                                                .cast("int"))).alias("seq"))
    orders = orders.withColumn("order_id", F.col("customer_id") * 3 + F.col("seq") - 1)
    orders = orders.select(
        "order_id", "customer_id",
        F.make_date(F.lit(2024), (_u(seed, "order_id", salt="month") % 3 + 1).cast("int"),
                    (_u(seed, "order_id", salt="day") % 28 + 1).cast("int")).alias("order_date"),
        _pick(STATUSES, _u(seed, "order_id", salt="status")).alias("status"),
        F.concat(F.col("address"), F.lit(", "), F.col("city"), F.lit(", "), F.col("state"), F.lit(" "),
                 F.col("zipcode")).alias("shipping_address"),
        _pick(PAYMENTS, _u(seed, "order_id", salt="payment")).alias("payment_method"))
    n_items = F.least(_u(seed, "order_id", salt="n_items") % 5 + 1, n_products).cast("int")
    start = _u(seed, "order_id", salt="start") % n_products
    slots = orders.select("order_id", F.explode(F.sequence(F.lit(0), n_items - 1)).alias("j"),
                          start.alias("__start"))
    slots = slots.withColumn("pos", (F.col("__start") + F.col("j")) % n_products)
    items = (slots.join(_number_products(products), "pos")
             .select((F.col("order_id") * 8 + F.col("j")).alias("order_item_id"), "order_id", "product_id",
                     (_u(seed, "order_id", "product_id", salt="qty") % 3 + 1).alias("quantity"),
                     F.col("price").alias("price_per_unit")))
    totals = items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("price_per_unit"))
                                           .cast("decimal(18,2)").alias("total_amount"))
    orders = orders.join(totals, "order_id").select(
        "order_id", "customer_id", "order_date", "total_amount", "status", "shipping_address", "payment_method")
    return {"orders": orders, "order_items": items}
