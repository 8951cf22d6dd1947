"""Best-fit packing with several permitted sequence lengths.

Pieces (documents, cut at the largest capacity) are packed in decreasing
order: each goes into the open bin it fills best, and where none fits a bin of
the least-cost size is opened. A sequence of ``c`` tokens costs ``OVERHEAD + c
+ c * c / QUADRATIC``, so middle sizes are cheapest per token. What a new bin
can hope to hold besides its first piece is read off the pieces still to come
that are short enough for its room. Other bins may take them; so at the end
every bin is downsized to the smallest capacity that holds its contents.

Pieces are dealt by a hash of their document into shards of about
``SHARD_ROWS`` rows, each packed by one task; only lengths and ids travel
there. With tens of thousands of pieces per shard, the loss against one global
packing is a few bins a shard, and no task grows with the input. Ties between
equal lengths go by text hash, id, piece and number of the copy, so the same
rows are packed alike however they are partitioned.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import count_words
from tessera.session import materialize, ship_package

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
OVERHEAD = 256  # cost of a sequence by itself
QUADRATIC = 65_536  # attention grows with the square of the tokens


def bin_cost(c: int) -> float:
    return OVERHEAD + c + c * c / QUADRATIC


def opening_size(n: int, caps, fitting) -> int:
    """Capacity with the least cost per token that the bin may come to hold;
    ``fitting(room)`` are the tokens still to come that could go there."""
    return min((c for c in caps if c >= n), key=lambda c: (bin_cost(c) / (n + min(c - n, fitting(c - n))), c))


def pack_lengths(lengths, capacities=CAPACITIES):
    """Bins for ``lengths`` given in decreasing order: lists ``bin_no`` and
    ``offset`` per item, and the final capacity of each bin. A length above
    the largest capacity is an error."""
    caps = sorted(capacities)
    if lengths and lengths[0] > caps[-1]:
        raise ValueError(f"length {lengths[0]} exceeds the largest capacity {caps[-1]}")
    rest = [0]  # rest[k]: tokens of the k shortest items
    for n in reversed(lengths):
        rest.append(rest[-1] + n)
    rising = lengths[::-1]
    open_bins: list[tuple[int, int]] = []  # (room, bin number), ordered
    used: list[int] = []
    where, offsets = [], []
    for i, n in enumerate(lengths):
        behind = len(lengths) - i - 1
        k = bisect.bisect_left(open_bins, (n, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            def fitting(space):
                return rest[min(behind, bisect.bisect_right(rising, space))]
            room = opening_size(n, caps, fitting)
            b = len(used)
            used.append(0)
        where.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            bisect.insort(open_bins, (room - n, b))
    return where, offsets, [next(c for c in caps if c >= u) for u in used]


def _pack_shard(frame: pd.DataFrame, capacities) -> pd.DataFrame:
    frame = frame.sort_values(["length", "text_hash", "doc_id", "piece", "copy"], ascending=[False, True, True, True, True],
                              kind="stable")
    where, offsets, sizes = pack_lengths(frame["length"].tolist(), capacities)
    base = int(frame["shard"].iloc[0]) << 32
    return pd.DataFrame({
        "doc_id": frame["doc_id"], "piece": frame["piece"], "start": frame["start"], "length": frame["length"],
        "bin_id": [base + b for b in where], "bin_capacity": [sizes[b] for b in where], "bin_offset": offsets})


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """``doc_id, text_hash, copy, piece, start, length`` in words; ``copy``
    numbers rows with the same id and text (counted before they are
    shuffled). Texts without words give one piece of length 0."""
    n = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), count_words(F.col("text")).alias("n"))
    n = n.groupBy("doc_id", "text_hash", "n").agg(F.count(F.lit(1)).alias("copies"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / longest)).cast("int")
    cut = n.select("doc_id", "text_hash", "n", count.alias("count"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    cut = cut.select("doc_id", "text_hash", "copy", "n", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut.select("doc_id", "text_hash", "copy", F.col("piece").cast("long").alias("piece"), start.alias("start"),
                      F.least(F.col("n") - start, F.lit(longest)).cast("long").alias("length"))


def pack_documents(docs: DataFrame, capacities=CAPACITIES) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_capacity, bin_offset``:
    where every word of ``docs`` (needs ``doc_id, text``; other columns are
    ignored) goes. Documents longer than the largest capacity are cut, none
    is dropped. Texts without words (NULL too) get one row of length 0
    without a bin. NULL ids and repeated rows are packed like others; equal
    lengths are ordered as the module says; an empty table gives no rows."""
    ship_package(docs.sparkSession)
    p = materialize(pieces(docs, max(capacities)))
    real = p.filter("length > 0")
    shards = max(1, -(-real.count() // SHARD_ROWS))
    dealt = real.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards))) \
        .withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, piece long, start long, length long, bin_id long, bin_capacity long, bin_offset long"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(frame, capacities)

    packed = dealt.groupBy("shard").applyInPandas(pack, schema) \
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    empty = p.filter("length = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("long").alias("bin_id"),
                                          F.lit(None).cast("long").alias("bin_capacity"),
                                          F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty)
