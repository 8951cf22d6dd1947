"""Q1-Q4: the declared constraints (NOT NULL, PRIMARY KEY / UNIQUE, FOREIGN
KEY) checked as data-quality jobs, and key-assigning appends.

Spark enforces none of these constraints, so each is a query: one aggregate
for NOT NULL, a grouped count for uniqueness (partial aggregation makes a hot
key cheap), a left-anti join for orphans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q1: NULL count per NOT NULL column, one scan."""
    stats = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
                        for i, c in enumerate(cols)])
    return stats.select(F.inline(entries))


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q2: key values that occur more than once, with their count."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("dup_count"))
            .filter(F.col("dup_count") > 1))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Q3: child rows whose foreign key has no parent row (NULL keys are not
    orphans, as in SQL)."""
    pk = parent_key or child_key
    p = parent.select(F.col(pk).alias("__pk")).distinct()
    return (child.filter(F.col(child_key).isNotNull())
            .join(p, F.col(child_key) == F.col("__pk"), "left_anti"))


def orphan_counts(checks: list[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Q3 summary: one row per foreign key with its orphan count."""
    parts = [orphans(c, p, ck, pk).agg(F.count(F.lit(1)).alias("orphan_count"))
             .select(F.lit(name).alias("foreign_key"), "orphan_count")
             for name, c, p, ck, pk in checks]
    return reduce(DataFrame.unionByName, parts)


def append_with_keys(target: DataFrame, rows: DataFrame, key: str, unique: str) -> DataFrame:
    """Q4: insert ``rows`` (without a ``key`` column) into ``target``.

    A row whose ``unique`` value already exists in the target is rejected;
    inside the batch the first row per value (smallest by the remaining
    columns) is inserted and the other rows with that value are rejected,
    instead of failing the whole batch. New keys continue after
    ``max(key)`` of the target in ``unique`` order.

    Output: the batch columns, ``key`` (NULL for rejects), ``outcome``
    (``inserted`` / ``rejected``) and ``copies`` (identical rows folded into
    one output row, so a value repeated a billion times is one row, not a
    billion rows in one task).

    A NULL ``unique`` value is rejected (the column is declared NOT NULL).

    Key assignment never funnels the batch through one task: accepted rows
    are range-partitioned by ``unique`` and numbered inside their partition,
    and that numbered table is written once to shared storage. Counts and
    offsets (one row per partition) come from the written rows, so they
    always belong to the partition numbers stored there, whatever a later
    job's partitioning is.
    """
    cols = list(rows.columns)
    other = [c for c in cols if c != unique]
    grouped = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    firsts = (grouped.filter(F.col(unique).isNotNull()).groupBy(unique)
              .agg(F.min(F.struct(*other)).alias("__first")))
    existing = target.select(F.col(unique).alias("__u")).distinct().withColumn("__exists", F.lit(True))
    j = (grouped.join(firsts, unique, "left")
         .join(existing, F.col(unique) == F.col("__u"), "left")
         .withColumn("__kept", F.col(unique).isNotNull() & F.col("__exists").isNull()
                     & F.struct(*[F.col(c) for c in other]).eqNullSafe(F.col("__first"))))

    base = target.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("m")).scalar()
    numbered = materialize(
        j.filter("__kept").select(*cols).repartitionByRange(unique).sortWithinPartitions(unique)
        .select("*", F.spark_partition_id().alias("__pid"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos")))
    counts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select("__pid", (F.sum("__cnt").over(Window.orderBy("__pid")) - F.col("__cnt"))
                            .alias("__off"))
    inserted = (numbered.join(F.broadcast(offsets), "__pid")
                .select(*cols, (base + F.col("__off") + F.col("__pos") + 1).alias(key),
                        F.lit("inserted").alias("outcome"), F.lit(1).cast("bigint").alias("copies")))
    rejected = (j.select(*cols, F.lit(None).cast("bigint").alias(key), F.lit("rejected").alias("outcome"),
                         F.when(F.col("__kept"), F.col("copies") - 1).otherwise(F.col("copies")).alias("copies"))
                .filter(F.col("copies") > 0))
    return inserted.unionByName(rejected)
