from decimal import Decimal

from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.operators.sales import order_total_reconciliation
from tessera.sources.generate import generate_sales
from tests.fixtures import customers5, products8, sales_gaps


def test_null_unique_orphans(spark):
    t = sales_gaps(spark)
    nv = {r.column_name: r.null_count for r in Q.null_violations(t["customers"], ["last_name", "state", "email"]).collect()}
    assert nv == {"last_name": 1, "state": 1, "email": 0}
    dup = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, e string")
    assert [(r.id, r.dup_count) for r in Q.unique_violations(dup, ["id"]).collect()] == [(1, 2)]
    items = t["order_items"].union(spark.createDataFrame([(9, 99, 1, 1, Decimal("1.00"))], t["order_items"].schema))
    assert [r.order_id for r in Q.orphans(items, t["orders"], "order_id").collect()] == [99]


def test_append_with_keys(spark):
    target = customers5(spark).select("customer_id", "first_name", "email")
    batch = spark.createDataFrame([
        ("Zed", "zed@x"), ("Amy", "amy@x"), ("Amy2", "amy@x"), ("Ada", "ada@shop.example"), ("Zed", "zed@x"),
    ], "first_name string, email string")
    out = {(r.first_name, r.email, r.outcome): (r.customer_id, r.copies)
           for r in Q.append_with_keys(target, batch, "customer_id", "email").collect()}
    assert out == {
        ("Amy", "amy@x", "inserted"): (6, 1),
        ("Zed", "zed@x", "inserted"): (7, 1),
        ("Zed", "zed@x", "rejected"): (None, 1),
        ("Amy2", "amy@x", "rejected"): (None, 1),
        ("Ada", "ada@shop.example", "rejected"): (None, 1),
    }


def test_generator_invariants(spark):
    g = generate_sales(customers5(spark), products8(spark), seed=3)
    orders, items = g["orders"], g["order_items"]
    assert order_total_reconciliation(orders, items).count() == 0
    per_c = [r[1] for r in orders.groupBy("customer_id").count().collect()]
    assert len(per_c) == 5 and all(1 <= n <= 3 for n in per_c)
    per_o = items.groupBy("order_id").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("d")).collect()
    assert all(1 <= r.n <= 5 and r.n == r.d for r in per_o)
    assert items.filter(~F.col("quantity").between(1, 3)).count() == 0
    dates = orders.select(F.month("order_date").alias("m"), F.dayofmonth("order_date").alias("d")).collect()
    assert all(1 <= r.m <= 3 and 1 <= r.d <= 28 for r in dates)
    again = generate_sales(customers5(spark), products8(spark), seed=3)["orders"]
    assert sorted(again.collect()) == sorted(orders.collect())
