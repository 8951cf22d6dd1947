"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w``, where ``u`` is a
uniform number derived from the seed and its id and ``w`` its quality weight.
Within a source the documents are taken in key order until the source's token
budget is used. A budget of ``e`` whole source sizes plus a rest is ``e``
complete epochs first, then the fractional selection of the rest; the
document on the boundary gives only the words that are still needed.

The running sum is distributed: keys are cut into ``BUCKETS`` ranges per
source by a monotone transform, bucket totals (at most ``BUCKETS`` rows per
source) are summed in order, and each (source, bucket) sums its own rows. A
source that holds a third of all rows is so spread over ``BUCKETS`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import SYMBOLS, count_chars_in, count_words, words

BUCKETS = 1024
WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
_U = float(1 << 48)


def quality_weight(text="text"):
    """Sampling weight of a text, 0.05 to 1: falls with its share of symbol
    characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = count_chars_in(t, SYMBOLS) / F.greatest(F.char_length(t), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - share * 10.0)


def source_targets(sized: DataFrame, cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Token target per source: weights repeat ``cycle`` over the sources in
    code-point order (NULL last) and share the total size; a target stops at
    ``max_epochs`` times its source's size, and the excess goes to the others
    by weight. One row per source; the two ordered passes read source rows
    only."""
    src = sized.groupBy("s_null", "s_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("s_null", "s_key")
    i = (F.row_number().over(order) - 1) % len(cycle)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), i + 1))
    cap = (F.col("source_size") * max_epochs).cast("double")
    fill = Window.orderBy(F.col("ratio"), "s_null", "s_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    src = (src.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
           .withColumn("level", (F.sum("source_size").over(every).cast("double")
                                 - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
                       / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))))
    # the first source (by cap per weight) that is not held back sets the level for all after it
    open_at = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "s_null", "s_key", "level"))
    level = F.min(open_at).over(every)["level"]
    return src.select("s_null", "s_key", "source_size",
                      F.least(F.col("cap"), F.coalesce(F.col("w") * level, F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
                carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``
    (with ``carry`` also ``row``, a struct of all columns). NULL text has size 0; NULL sources form one source, last in the
    order; a NULL id counts as the empty id. An empty table gives no rows, a
    corpus without words takes nothing. Rows with equal ids draw the same
    ``u`` and are ordered by size and text hash; identical rows are
    interchangeable. The result depends on the rows alone, not on their
    layout, so reruns agree."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
                           1, 12), 16, 10).cast("double")
    rows = docs.select(
        "doc_id", *([F.struct("*").alias("row")] if carry else []), F.col("source").isNull().alias("s_null"),
        F.coalesce(F.col("source"), F.lit("")).alias("s_key"), count_words(F.col("text")).alias("size"),
        (-F.log((u + 0.5) / _U) / quality_weight()).alias("key"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    rows = rows.withColumn("bucket", F.least(F.floor((1.0 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)))
    totals = rows.groupBy("s_null", "s_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("s_null", "s_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s_null", "s_key", "bucket",
                            F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    targets = source_targets(totals.withColumnRenamed("bucket_size", "size"), cycle, max_epochs)
    plan = offsets.join(targets, ["s_null", "s_key"])
    budget = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    inside = Window.partitionBy("s_null", "s_key", "bucket").orderBy("key", "doc_id", "size", "tie") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.join(plan, ["s_null", "s_key", "bucket"])
            .withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
            .withColumn("epochs", F.floor(budget / size).cast("long"))
            .withColumn("rest", budget - F.col("epochs") * size)
            .select("doc_id", *(["row"] if carry else []), "size", "source_size", "target",
                    (F.col("epochs") * F.col("size")
                     + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("start"))))
                    .cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document appears once
    per complete epoch, and the fractional selection adds it once more (the
    boundary document cut to the words that are still needed). ``n_chars`` of
    a cut text is recounted."""
    mixed = mix_sources(docs, carry=True, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    lengths = F.concat(F.array_repeat(F.lit(-1), whole),
                       F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = mixed.select("row", F.explode(lengths).alias("cut"))
    short = F.array_join(F.slice(words(F.col("row.text")), 1, F.greatest(F.col("cut"), F.lit(1))), " ")

    def column(c):
        if c == "text":
            return F.when(F.col("cut") < 0, F.col("row.text")).otherwise(short).alias(c)
        if c == "n_chars":
            return F.when(F.col("cut") < 0, F.col("row.n_chars")).otherwise(F.char_length(short).cast("long")).alias(c)
        return F.col("row")[c].alias(c)
    return out.select(*map(column, docs.columns))


_ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
keyed AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5)
                / 281474976710656.0)
            / greatest(0.05, 1.0 - (length(t) - length(translate(t, '#*$%&|<>', ''))) / greatest(length(t), 1) * 10.0)
            AS key
  FROM sized),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source),
fill AS (
  SELECT *, 3.0 * source_size / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM src WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CAST(least(3.0 * source_size,
                    w * (SELECT arg_min(level, ratio) FROM fill WHERE ratio >= level)) AS DOUBLE) AS target
  FROM fill),
placed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target,
         CAST(floor(s.target) AS BIGINT) // greatest(s.source_size, 1) AS epochs,
         CAST(floor(s.target) AS BIGINT) % greatest(s.source_size, 1) AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS start
  FROM keyed k JOIN targets s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, rest - start)) AS BIGINT) AS taken
FROM placed
"""


def oracle() -> str:
    """DuckDB SQL for ``mix_sources(documents)``."""
    return _ORACLE.replace("{seed}", SEED)
