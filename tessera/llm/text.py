"""Word handling shared by the operators: SQL expressions and a byte-level
tokeniser for Python workers. A word is ``[^\\x20\\x09-\\x0D]+``; NULL text
has no words."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with leading underscores, so that no column of ``df`` has it."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """Array of the words of a text (empty for NULL)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_chars_in(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars`` (0 for NULL)."""
    t = F.coalesce(text, F.lit(""))
    return (F.char_length(t) - F.char_length(F.translate(t, chars, ""))).cast("long")


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8 bytes. ``bytes.split`` cuts at exactly the blanks above
    and ``bytes.lower`` changes A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer, so that sums of word hashes spread over 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive words, in text order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return mix64(acc)
