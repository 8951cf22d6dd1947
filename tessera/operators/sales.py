"""Sales operators: projections (P1-P4), joins (J1-J6) and aggregates.

Plan shape used throughout: aggregate the fact table (orders / order_items) by
its foreign key *before* joining the dimension. Partial aggregation runs
map-side, so a hot product or customer (even one holding a third of all
rows) only contributes one partial row per task to the shuffle, and the join
then sees unique keys on both sides. Catalyst does not push aggregates below
joins on its own, so this is written by hand (valid because product_id and
customer_id are the dimension keys). Join strategy is left to AQE: a side
that turns out small at runtime is broadcast from its measured size; large
sides stay sort-merge joins.

Money is summed as DECIMAL(18,2) and leaves as DOUBLE; averages are
sum / count in double precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import ratio, round_half_up_money, to_double


# ---------------------------------------------------------------- scalar

def customer_name(first="first_name", last="last_name"):
    """``first || ' ' || last``; NULL when either part is NULL."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def shipping_address_col():
    """``"{address}, {city}, {state} {zipcode}"`` (NULL propagates)."""
    return F.concat(F.col("address"), F.lit(", "), F.col("city"), F.lit(", "),
                    F.col("state"), F.lit(" "), F.col("zipcode"))


def line_revenue(qty="quantity", price="price_per_unit"):
    """Quantity x price per unit, exact decimal."""
    return F.col(qty) * F.col(price)


def with_shipping_address(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """P3 applied to orders: the reference looks the address up once per
    order; here it is one equi-join on customer_id."""
    addr = customers.select("customer_id", shipping_address_col().alias("__addr"))
    return (orders.drop("shipping_address").join(addr, "customer_id", "left")
            .withColumnRenamed("__addr", "shipping_address")
            .select("order_id", "customer_id", "order_date", to_double("total_amount").alias("total_amount"),
                    "status", "shipping_address", "payment_method"))


# ---------------------------------------------------------------- filter

def low_stock(products: DataFrame, threshold: int = 50) -> DataFrame:
    """Products with ``stock_quantity < threshold`` (strict), ascending."""
    return (products.filter(F.col("stock_quantity") < threshold)
            .select("product_id", "name", "category", "stock_quantity",
                    to_double("price").alias("price"))
            .orderBy("stock_quantity", "product_id"))


# ---------------------------------------------------------------- pre-aggregates

def _item_totals_by_product(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"),
        F.sum(line_revenue()).alias("revenue_dec"))


def _order_totals_by_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"),
        F.sum("total_amount").alias("spent_dec"))


# ---------------------------------------------------------------- joins

def top_products(products: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """Units and revenue per sold product, top ``k`` by revenue
    (ties broken by product_id). Global top-k plans as TakeOrderedAndProject:
    each task keeps k rows, the driver merges k x tasks."""
    j = (_item_totals_by_product(items)
         .join(products.select("product_id", "name", "category", "price"), "product_id"))
    top = (j.select("product_id", "name", "category", to_double("price").alias("price"),
                    "units_sold", to_double("revenue_dec").alias("revenue"),
                    F.col("revenue_dec"))
           .orderBy(F.col("revenue_dec").desc(), "product_id").limit(k))
    w = Window.orderBy(F.col("revenue_dec").desc(), "product_id")
    return top.withColumn("rank", F.row_number().over(w)).drop("revenue_dec")


def category_sales(products: DataFrame, items: DataFrame) -> DataFrame:
    """Units and revenue per category, revenue descending."""
    j = (_item_totals_by_product(items)
         .join(products.select("product_id", "category"), "product_id"))
    return (j.groupBy("category")
            .agg(F.sum("units_sold").alias("units_sold"), F.sum("revenue_dec").alias("revenue_dec"))
            .orderBy(F.col("revenue_dec").desc(), "category")
            .select("category", "units_sold", to_double("revenue_dec").alias("revenue")))


def top_customers(customers: DataFrame, orders: DataFrame, k: int = 5) -> DataFrame:
    """Order count, total and average spend per customer, top ``k``."""
    j = (_order_totals_by_customer(orders)
         .join(customers.select("customer_id", customer_name().alias("customer_name")), "customer_id"))
    top = (j.orderBy(F.col("spent_dec").desc(), "customer_id").limit(k)
           .select("customer_id", "customer_name", "order_count",
                   to_double("spent_dec").alias("total_spent"),
                   ratio("spent_dec", "order_count").alias("avg_order_value"),
                   "spent_dec"))
    w = Window.orderBy(F.col("spent_dec").desc(), "customer_id")
    return top.withColumn("rank", F.row_number().over(w)).drop("spent_dec")


def customer_orders_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer, with order count 0 and NULL total when none."""
    j = customers.join(_order_totals_by_customer(orders), "customer_id", "left")
    return j.select("customer_id", "first_name", "last_name", "email",
                    F.coalesce("order_count", F.lit(0)).alias("order_count"),
                    to_double("spent_dec").alias("total_spent"))


def product_sales_summary(products: DataFrame, items: DataFrame) -> DataFrame:
    """Every product with units and revenue; unsold products keep NULLs
    and sort last."""
    j = products.join(_item_totals_by_product(items), "product_id", "left")
    return (j.orderBy(F.col("revenue_dec").desc_nulls_last(), "product_id")
            .select("product_id", "name", "category", to_double("price").alias("price"),
                    "units_sold", to_double("revenue_dec").alias("revenue")))


def price_lookup(items: DataFrame, products: DataFrame) -> DataFrame:
    """Attach the product's list price to each order item (one join
    instead of one lookup per item). A hot product_id is split by AQE's
    skew-join handling; the product side has unique keys."""
    p = products.select("product_id", F.col("price").alias("list_price"))
    return (items.join(p, "product_id", "left")
            .select("order_item_id", "order_id", "product_id", "quantity",
                    to_double("price_per_unit").alias("price_per_unit"),
                    to_double("list_price").alias("list_price")))


# ---------------------------------------------------------------- aggregates

def sales_totals(orders: DataFrame) -> DataFrame:
    """A1: order count, revenue and average order value (NULL when empty)."""
    return (orders.agg(F.count(F.lit(1)).alias("order_count"),
                       F.sum("total_amount").alias("rev"))
            .select("order_count", to_double("rev").alias("total_revenue"),
                    ratio("rev", "order_count").alias("avg_order_value")))


def status_breakdown(orders: DataFrame) -> DataFrame:
    """A2: per status count, total and ``ROUND(AVG, 2)``, by count desc."""
    return (orders.groupBy("status")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("total_amount").alias("tot"))
            .orderBy(F.col("order_count").desc(), "status")
            .select("status", "order_count", to_double("tot").alias("total_amount"),
                    round_half_up_money("tot", "order_count").alias("avg_amount")))


def products_per_category(products: DataFrame) -> DataFrame:
    """A3: product count per category, descending."""
    return (products.groupBy("category").agg(F.count(F.lit(1)).alias("product_count"))
            .orderBy(F.col("product_count").desc(), "category"))


def customer_count(customers: DataFrame) -> DataFrame:
    """A4."""
    return customers.agg(F.count(F.lit(1)).alias("customer_count"))


def customers_per_state(customers: DataFrame) -> DataFrame:
    """A5: customers per state; a NULL state is its own group."""
    return (customers.groupBy("state").agg(F.count(F.lit(1)).alias("customer_count"))
            .orderBy(F.col("customer_count").desc(), F.col("state").asc_nulls_last()))


def inventory_stats(products: DataFrame) -> DataFrame:
    """Total, average, min and max stock in one pass."""
    return (products.agg(F.sum("stock_quantity").alias("total_units"),
                         F.count("stock_quantity").alias("n"),
                         F.min("stock_quantity").alias("min_stock"),
                         F.max("stock_quantity").alias("max_stock"))
            .select("total_units", ratio("total_units", "n").alias("avg_stock"),
                    "min_stock", "max_stock"))


def payment_breakdown(orders: DataFrame) -> DataFrame:
    """Per payment method count, revenue, average and share of all
    orders in percent. The share uses a window over the grouped rows only
    (one row per method), never over the orders."""
    g = (orders.groupBy("payment_method")
         .agg(F.count(F.lit(1)).alias("order_count"), F.sum("total_amount").alias("rev")))
    share = F.lit(100.0) * F.col("order_count").cast("double") / F.sum("order_count").over(Window.partitionBy()).cast("double")
    return (g.select("payment_method", "order_count", to_double("rev").alias("total_revenue"),
                     ratio("rev", "order_count").alias("avg_order_value"),
                     share.alias("percent_of_orders"), "rev")
            .orderBy(F.col("rev").desc(), "payment_method").drop("rev"))


def order_totals(items: DataFrame) -> DataFrame:
    """Order total = sum of quantity x price per unit, per order."""
    return (items.groupBy("order_id").agg(F.sum(line_revenue()).alias("tot"))
            .select("order_id", to_double("tot").alias("order_total")))


def order_total_reconciliation(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose stored total differs from the item sum, or that have
    no items. Items are reduced to one row per order before the join."""
    sums = items.groupBy("order_id").agg(F.sum(line_revenue()).alias("items_dec"))
    j = orders.select("order_id", "total_amount").join(sums, "order_id", "left")
    issue = (F.when(F.col("items_dec").isNull(), F.lit("no_items"))
             .when(F.col("items_dec") != F.col("total_amount"), F.lit("mismatch")))
    return (j.withColumn("issue", issue).filter(F.col("issue").isNotNull())
            .select("order_id", to_double("total_amount").alias("total_amount"),
                    to_double("items_dec").alias("items_total"), "issue"))
