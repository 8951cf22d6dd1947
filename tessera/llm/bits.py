"""A fixed-size membership filter that is broadcast to Python workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_filter(df: DataFrame, number: Column, size: int) -> np.ndarray:
    """Bit table of ``size`` bits (a power of two) with a bit per value of
    ``number`` (long). Its size does not grow with the data; where it fills
    up it only lets more candidates through to the exact join behind it."""
    bit = F.pmod(number, F.lit(size))
    words = (df.select(bit.bitwiseAND(F.lit(63)).cast("int").alias("b"), F.shiftright(bit, 6).cast("int").alias("w"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas())
    table = np.zeros(size // 64, dtype=np.uint64)
    table[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def may_contain(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For signed 64-bit ``numbers``: is the bit set?"""
    b = numbers.astype(np.int64).view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return ((table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
