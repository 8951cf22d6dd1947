"""R1 sales report as a table of lines, and P8 the report time stamp.

``sales_report_lines`` returns ``(section, part, line_no, tiebreak, line)``;
ordering by those four columns and joining ``line`` with newlines gives the
report text (the reference's line strings, including their leading
newlines, are kept as they are). Nothing is collected: each section is a
small aggregate rendered with ``format_string``; list lines carry their order
in ``line_no`` (rank or group position) so no window ever spans the data.

Shared scans: every aggregate is one branch that emits several lines per row.
Orders are read once for the totals, the status and the payment sections and
products once for categories, inventory and the low-stock heading (GROUPING
SETS with the grand total, see ``_with_total``); customers once for the count
and the states. The rankings read their own per-key totals and the low-stock
list its own filter, so orders, order items and customers are scanned twice
and products four times.

Number formatting works on exact decimals and rounds half-up; Python's
``%.2f`` on binary floats rounds an exact tie such as 12.25% to even (12.2)
where this prints 12.3.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import fmt_fixed, fmt_or_na
from tessera.operators import sales as S

RULE = "=" * 80
DASH = "-" * 30

# Fixed report texts (values that must equal the reference's output).
TITLE = "ONLINE SALES DATABASE ANALYSIS REPORT"
HEADINGS = {
    1: "\n1. OVERALL SALES SUMMARY",
    2: "\n\n2. PRODUCT ANALYSIS",
    3: "\n\n3. CUSTOMER ANALYSIS",
    4: "\n\n4. INVENTORY STATUS",
    5: "\n\n5. PAYMENT METHOD ANALYSIS",
}

STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def now_stamp(ts=None):
    """``yyyy-MM-dd HH:mm:ss`` of ``ts`` (default: query start time)."""
    return F.date_format(F.current_timestamp() if ts is None else ts, STAMP_FORMAT)


def _spark(df: DataFrame):
    return df.sparkSession


class _Fixed:
    """Collects the constant report lines into one single-partition frame."""

    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def __call__(self, spark, section: int, part: int, items: list[tuple[int, str]]):
        self.rows += [(section, part, n, 0, text) for n, text in items]
        return None

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.rows, "section int, part int, line_no bigint, tiebreak bigint, line string").coalesce(1)


def _line(section: int, part: int, line_no, text, tiebreak=None, when=None):
    """One report line; with ``when`` only for rows where that holds."""
    line = F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"),
                    line_no.cast("bigint").alias("line_no"),
                    (F.lit(0) if tiebreak is None else tiebreak).cast("bigint").alias("tiebreak"),
                    text.alias("line"))
    return line if when is None else F.when(when, line)


def _emit(df: DataFrame, *lines) -> DataFrame:
    """The lines of every row of ``df`` in one pass over it."""
    return df.select(F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))


def _with_total(df: DataFrame, sets: list, keys: list, sums: dict, others: dict | None = None) -> DataFrame:
    """``df`` aggregated by each grouping set and over all rows: ``keys``, the
    grouping id ``gid`` and the named aggregates. A constant empty row is
    merged in, so that the grand total exists for an empty table too.
    ``sums`` add up over groups, ``others`` are (aggregate, merging function)."""
    others = others or {}
    g = df.groupingSets([*sets, []], *keys).agg(
        F.grouping_id().alias("gid"), *[c.alias(n) for n, c in sums.items()],
        *[c.alias(n) for n, (c, _) in others.items()])
    types = dict(g.dtypes)
    none = df.sparkSession.range(1, numPartitions=1).select(*[
        F.lit(2 ** len(keys) - 1 if c == "gid" else None).cast(types[c]).alias(c) for c in g.columns])
    return g.unionByName(none).groupBy(*keys, "gid").agg(
        *[F.sum(n).alias(n) for n in sums], *[merge(n).alias(n) for n, (_, merge) in others.items()])


def _none(c):
    """Python prints a missing value as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _round_dec(num, den, scale):
    return F.round(F.try_divide(num.cast("decimal(38,2)"), den.cast("decimal(38,0)")), scale)


def sales_report_lines(tables: dict[str, DataFrame], generated_on: str | None = None,
                       low_stock_threshold: int = 50, top_k: int = 5) -> DataFrame:
    customers, products = tables["customers"], tables["products"]
    orders, items = tables["orders"], tables["order_items"]
    spark = _spark(orders)
    _lines = _Fixed(spark)
    parts = []

    # header
    stamp = F.lit(generated_on) if generated_on is not None else now_stamp()
    _lines(spark, 0, 0, [(1, RULE), (2, TITLE), (4, RULE)])
    parts.append(_emit(spark.range(1, numPartitions=1),
                       _line(0, 0, F.lit(3), F.concat(F.lit("Generated on: "), stamp))))

    # 1. overall + status, 5. payment methods (one scan of orders)
    gid, n, tot = F.col("gid"), F.col("n"), F.col("tot")
    og = _with_total(orders, [["status"], ["payment_method"]], ["status", "payment_method"],
                     {"n": F.count(F.lit(1)), "tot": F.sum("total_amount")})
    by_status, by_payment, total = gid == 1, gid == 2, gid == 3
    order = Window.partitionBy("gid").orderBy(
        F.when(by_status, n.cast("decimal(38,2)")).otherwise(tot.cast("decimal(38,2)")).desc(),
        F.when(by_status, F.col("status")).otherwise(F.col("payment_method")).asc_nulls_last())
    og = og.select("*", F.row_number().over(order).alias("pos"), F.round(
        F.try_divide(n.cast("decimal(38,0)") * 100, F.sum("n").over(Window.partitionBy("gid")).cast("decimal(38,0)")), 1)
        .alias("pct"))
    avg = _round_dec(tot, n, 2)
    orders_n = F.coalesce(n, F.lit(0)).cast("string")
    _lines(spark, 1, 0, [(1, HEADINGS[1]), (2, DASH)])
    _lines(spark, 1, 1, [(0, "\nOrder Status Breakdown:")])
    _lines(spark, 5, 0, [(1, HEADINGS[5]), (2, DASH), (3, "Payment Method Breakdown:")])
    parts.append(_emit(
        og,
        _line(1, 0, F.lit(3), F.concat(F.lit("Total Orders: "), orders_n), when=total),
        _line(1, 0, F.lit(4), F.concat(F.lit("Total Revenue: $"), fmt_or_na(tot, 2)), when=total),
        _line(1, 0, F.lit(5), F.concat(F.lit("Average Order Value: $"), fmt_or_na(avg, 2)), when=total),
        _line(1, 1, F.col("pos"), F.concat(
            F.lit("  "), _none(F.col("status")), F.lit(": "), orders_n, F.lit(" orders, $"), fmt_fixed(tot, 2),
            F.lit(" total, $"), fmt_fixed(avg, 2), F.lit(" avg")), when=by_status),
        _line(5, 1, F.col("pos") * 2 - 1, F.concat(
            F.lit("  "), _none(F.col("payment_method")), F.lit(": "), orders_n, F.lit(" orders ("),
            fmt_fixed(F.col("pct"), 1), F.lit("%)")), when=by_payment),
        _line(5, 1, F.col("pos") * 2, F.concat(
            F.lit("     Total Revenue: $"), fmt_fixed(tot, 2), F.lit(" | Avg Order: $"), fmt_fixed(avg, 2)),
            when=by_payment)))

    # 2. categories, 4. inventory (one scan of products)
    stock = F.col("stock_quantity")
    pg = _with_total(products, [["category"]], ["category"],
                     {"n": F.count(F.lit(1)), "stock": F.sum(stock), "stock_n": F.count(stock),
                      "low_n": F.count_if(stock < low_stock_threshold)},
                     {"mn": (F.min(stock), F.min), "mx": (F.max(stock), F.max)})
    by_category, all_products = gid == 0, gid == 1
    w_cat = Window.partitionBy("gid").orderBy(n.desc(), F.col("category").asc_nulls_last())
    _lines(spark, 2, 0, [(1, HEADINGS[2]), (2, DASH), (3, "Product Categories:")])
    _lines(spark, 4, 0, [(1, HEADINGS[4]), (2, DASH)])

    def or_na(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    parts.append(_emit(
        pg.withColumn("pos", F.row_number().over(w_cat)),
        _line(2, 1, F.col("pos"), F.concat(
            F.lit("  "), _none(F.col("category")), F.lit(": "), n.cast("string"), F.lit(" products")), when=by_category),
        _line(4, 0, F.lit(3), F.concat(F.lit("Total Inventory: "), or_na("stock"), F.lit(" units")), when=all_products),
        _line(4, 0, F.lit(4), F.concat(
            F.lit("Average Stock per Product: "), fmt_or_na(_round_dec(F.col("stock"), F.col("stock_n"), 1), 1),
            F.lit(" units")), when=all_products),
        _line(4, 0, F.lit(5), F.concat(
            F.lit("Stock Range: "), or_na("mn"), F.lit(" to "), or_na("mx"), F.lit(" units")), when=all_products),
        # the heading appears only when there is at least one low-stock row
        _line(4, 1, F.lit(1), F.lit(f"\nLow Stock Products (less than {low_stock_threshold} units):"),
              when=all_products & (F.col("low_n") > 0))))
    parts.append(_emit(S.low_stock(products, low_stock_threshold), _line(4, 2, stock, F.concat(
        F.lit("  "), _none(F.col("name")), F.lit(" ("), _none(F.col("category")), F.lit("): "),
        stock.cast("string"), F.lit(" units left | $"), fmt_fixed(F.col("price"), 2)),
        tiebreak=F.col("product_id"))))
    rank = F.col("rank")
    _lines(spark, 2, 2, [(0, "\nTop 5 Products by Revenue:".replace("5", str(top_k)))])
    parts.append(_emit(
        S.top_products(products, items, top_k),
        _line(2, 2, rank * 2 - 1, F.concat(F.lit("  "), rank.cast("string"), F.lit(". "), _none(F.col("name")),
                                           F.lit(" ("), _none(F.col("category")), F.lit(")"))),
        _line(2, 2, rank * 2, F.concat(
            F.lit("     Price: $"), fmt_fixed(F.col("price"), 2), F.lit(" | Units Sold: "),
            F.col("units_sold").cast("string"), F.lit(" | Revenue: $"), fmt_fixed(F.col("revenue"), 2)))))
    _lines(spark, 2, 3, [(0, "\nSales by Category:")])
    w_cs = Window.orderBy(F.col("revenue").desc(), F.col("category").asc_nulls_last())
    parts.append(_emit(S.category_sales(products, items).withColumn("pos", F.row_number().over(w_cs)), _line(
        2, 3, F.col("pos"), F.concat(
            F.lit("  "), _none(F.col("category")), F.lit(": "), F.col("units_sold").cast("string"),
            F.lit(" units, $"), fmt_fixed(F.col("revenue"), 2), F.lit(" revenue")))))

    # 3. customers (one scan for the count and the states)
    cg = _with_total(customers, [["state"]], ["state"], {"n": F.count(F.lit(1))})
    w_state = Window.partitionBy("gid").orderBy(n.desc(), F.col("state").asc_nulls_last())
    _lines(spark, 3, 0, [(1, HEADINGS[3]), (2, DASH)])
    _lines(spark, 3, 2, [(0, "\nCustomer Distribution by State:")])
    customers_n = F.coalesce(n, F.lit(0)).cast("string")
    parts.append(_emit(
        cg.withColumn("pos", F.row_number().over(w_state)),
        _line(3, 0, F.lit(3), F.concat(F.lit("Total Customers: "), customers_n), when=gid == 1),
        _line(3, 2, F.col("pos"), F.concat(
            F.lit("  "), _none(F.col("state")), F.lit(": "), customers_n, F.lit(" customers")), when=gid == 0)))
    _lines(spark, 3, 1, [(0, "\nTop 5 Customers by Spending:".replace("5", str(top_k)))])
    parts.append(_emit(
        S.top_customers(customers, orders, top_k),
        _line(3, 1, rank * 2 - 1, F.concat(F.lit("  "), rank.cast("string"), F.lit(". "), _none(F.col("customer_name")))),
        _line(3, 1, rank * 2, F.concat(
            F.lit("     Orders: "), F.col("order_count").cast("string"), F.lit(" | Total Spent: $"),
            fmt_fixed(F.col("total_spent"), 2), F.lit(" | Avg Order: $"),
            fmt_fixed(F.round(F.col("total_spent").cast("decimal(38,2)") / F.col("order_count"), 2), 2)))))

    return reduce(DataFrame.unionByName, [*parts, _lines.frame()])


def write_report_text(lines: DataFrame, path: str) -> None:
    """Save the report as text: a global sort on the line keys (range
    partitioned, so no task holds every line) written as part files whose
    name order is the line order; concatenated they are the report."""
    (lines.orderBy("section", "part", "line_no", "tiebreak").select("line")
     .write.mode("overwrite").text(path))
