"""L1-L3 object listing and P5 the supported-extension test.

Input: a DataFrame with a ``key`` column (object keys, ``/``-separated;
keys ending in ``/`` are folder markers). Listing lines carry a sort key
instead of a global line number, so no window spans the listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extensions the indexer reads (matched case-insensitively).
SUPPORTED_EXTENSIONS = (".txt", ".md", ".csv", ".log", ".pdf")


def url_key(url="url"):
    """Object key of a URL: drop the scheme, the query and the fragment."""
    return F.regexp_replace(F.regexp_replace(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
                            r"[?#].*$", "")


def keys_from_urls(pages: DataFrame) -> DataFrame:
    """Object keys from page URLs."""
    return pages.select(url_key().alias("key"))


def keys_from_documents(documents: DataFrame) -> DataFrame:
    """Object keys for the document corpus: ``source/lang/doc_id.txt``."""
    return documents.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"),
        "doc_id", "text")


def folder_of(key="key"):
    """The immediate folder of a key: a key ending in ``/`` is its own folder,
    a file's folder is everything up to its last ``/``; root files have none."""
    return F.regexp_extract(F.col(key), r"^(.*/)[^/]*$", 1)


def folders(keys: DataFrame) -> DataFrame:
    """L1: distinct folders, sorted."""
    f = keys.select(folder_of().alias("folder")).filter(F.col("folder") != "")
    return f.distinct().orderBy("folder")


def files(keys: DataFrame) -> DataFrame:
    """L2: keys that are not folder markers, sorted, duplicates kept."""
    return keys.filter(~F.col("key").endswith("/")).select(F.col("key").alias("file")).orderBy("file")


def listing_lines(keys: DataFrame) -> DataFrame:
    """L3: ``Folders:`` block, blank line, ``Files:`` block as
    ``(part, sort_key, line)``; order by ``part, sort_key`` to print."""
    spark = keys.sparkSession
    heads = spark.createDataFrame([(0, "", "Folders:"), (2, "", "\nFiles:")],
                                  "part int, sort_key string, line string")
    fo = folders(keys).select(F.lit(1).alias("part"), F.col("folder").alias("sort_key"),
                              F.concat(F.lit("  - "), F.col("folder")).alias("line"))
    fi = files(keys).select(F.lit(3).alias("part"), F.col("file").alias("sort_key"),
                            F.concat(F.lit("  - "), F.col("file")).alias("line"))
    return heads.unionByName(fo).unionByName(fi)


def supported_files(keys: DataFrame, extensions=SUPPORTED_EXTENSIONS) -> DataFrame:
    """P5: case-insensitive extension test; others get status ``Skipped``."""
    low = F.lower(F.col("key"))
    ok = F.lit(False)
    for e in extensions:
        ok = ok | low.endswith(e)
    return keys.withColumn("supported", ok).withColumn(
        "status", F.when(ok, F.lit("Supported")).otherwise(F.lit("Skipped")))
