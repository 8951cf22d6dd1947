"""The four sales tables, table dumps, the schema catalog and the
synthetic sales generator.

``load_sales`` maps the driver's TPC-H-like tables onto the logical sales
schema (customers, products, orders, order_items). The mapping is a plain
projection plus one join to ``nation``; Catalyst prunes every column a query
does not use, so a two-column report never reads the rest of the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import MONEY

SALES_TABLES = ("customers", "products", "orders", "order_items")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    # nation is the fixed 25-row TPC-H dimension at every scale factor, so a
    # broadcast here has a proven size bound.
    n = F.broadcast(nation.select("n_nationkey", "n_name"))
    return (customer.join(n, customer.c_nationkey == n.n_nationkey, "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.substring_index("c_name", "#", 1).alias("first_name"),
                F.expr("substr(c_name, instr(c_name, '#') + 1)").alias("last_name"),
                F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                F.col("c_name").alias("address"),
                F.col("c_mktsegment").alias("city"),
                F.col("n_name").alias("state"),
                F.col("c_custkey").cast("string").alias("zipcode"),
                F.lit(None).cast("date").alias("registration_date"),
                F.lit(None).cast("date").alias("last_login"),
            ))


def products_from(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.col("p_size").cast("bigint").alias("stock_quantity"),
        F.lit(None).cast("date").alias("created_date"),
    )


def orders_from(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderstatus").alias("status"),
        F.lit(None).cast("string").alias("shipping_address"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def order_items_from(lineitem: DataFrame) -> DataFrame:
    # lineitem has no unique key (duplicate (orderkey, linenumber) pairs), so
    # order_item_id is a deterministic stand-in, not a primary key.
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price_per_unit"),
    )


def load_sales(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Typed, lazy scans of the four sales tables."""
    return {
        "customers": customers_from(_read(spark, sf_dir, "customer"),
                                    _read(spark, sf_dir, "nation")),
        "products": products_from(_read(spark, sf_dir, "part")),
        "orders": orders_from(_read(spark, sf_dir, "orders")),
        "order_items": order_items_from(_read(spark, sf_dir, "lineitem")),
    }


def table_dump(tables: dict[str, DataFrame], name: str, preview: int | None = None) -> DataFrame:
    """``SELECT *`` of one table; ``preview`` is the display limit."""
    df = tables[name]
    return df.limit(preview) if preview is not None else df


# Declared primary keys of the logical schema.
SALES_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}


def schema_catalog(tables: dict[str, DataFrame], keys: dict[str, str] | None = None) -> DataFrame:
    """S3: one row per table and column with its type, the declared key flag,
    the NULL count and, for the declared key column, whether the key really
    holds (no NULLs and as many distinct values as rows; Parquet carries no
    key metadata). One aggregate per table; only the key column gets a
    distinct count, so the plan has no Expand of the whole table."""
    keys = SALES_KEYS if keys is None else keys
    parts = []
    for tname, df in tables.items():
        cols = df.schema.fields
        key = keys.get(tname)
        aggs = [F.count(F.lit(1)).alias("__rows")]
        aggs += [F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(cols)]
        aggs.append(F.count_distinct(F.col(key)).alias("__distinct") if key
                    else F.lit(None).cast("bigint").alias("__distinct"))
        stats = df.agg(*aggs)
        entries = F.array(*[
            F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.lit(f.name == key).alias("is_key"),
                     F.col(f"n{i}").alias("nulls"))
            for i, f in enumerate(cols)])
        parts.append(stats.select(F.lit(tname).alias("table_name"), F.col("__rows").alias("row_count"),
                                  F.col("__distinct"), F.inline(entries)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        "table_name", "ordinal", "column_name", "data_type", "is_key", "row_count", "nulls",
        F.when(F.col("is_key"), (F.col("nulls") == 0) & (F.col("__distinct") == F.col("row_count")))
        .alias("key_holds"))


SKETCH_LG = 14          # 2 ** 14 registers per column
LIKELY = 0.95           # of the rows; the estimate is off by less than 1 % (one standard deviation)


def discover_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """S3 without declared keys: ``(table_name, ordinal, column_name,
    row_count, nulls, is_key)``; a key has no NULL and no value twice. An empty
    table has no key.

    One pass per table estimates the distinct values of all columns
    (HyperLogLog, a sketch of fixed size). Only columns without NULLs whose
    estimate is at least ``LIKELY`` of the rows are counted exactly, each with a
    grouped count of its own."""
    parts = []
    for tname, df in tables.items():
        names = df.columns
        one = df.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
                     *[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_LG))).alias(f"d{i}")
                       for i, c in enumerate(names)]).first()  # one row
        rows = one["rows"]
        likely = [i for i in range(len(names)) if rows and not one[f"n{i}"] and one[f"d{i}"] >= LIKELY * rows]
        for i, c in enumerate(names):
            fixed = [F.lit(tname).alias("table_name"), F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                     F.lit(rows).cast("long").alias("row_count"), F.lit(one[f"n{i}"]).cast("long").alias("nulls")]
            if i in likely:
                most = df.groupBy(F.col(c)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
                parts.append(most.select(*fixed, (F.col("n") == 1).alias("is_key")))
            else:
                parts.append(df.sparkSession.range(1).select(*fixed, F.lit(False).alias("is_key")))
    return reduce(DataFrame.unionByName, parts)
