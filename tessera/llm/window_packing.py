"""Bounded-space online packing of tokenised documents.

Every partition streams its documents through ``OPEN_WINDOWS`` open windows
of ``CAPACITY`` tokens: whole windows of a long document are sequences of
their own, the rest goes into the window it fills best. Where none has room,
a new window is opened, or, when the fixed number is open, the fullest is
emitted, topped up with the head of the document so that it carries no
padding; the rest of the document is placed the same way.

Windows still open at the end of a partition are merged: the leftovers of
``FAN`` partitions go through one more packer, the leftovers of ``FAN`` of
these through another, until one group is left (4 rounds for a million
partitions). It fills its last windows to the brim; what stays under one
capacity is cut at powers of two, which need no padding.

A task holds at most ``OPEN_WINDOWS`` windows (a merging one, ``FAN`` times as
many) and one document. The packed pieces, ids included, are written once;
merging reads the leftovers from there, so a lost executor costs a re-read.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship_package

CAPACITY = 1024
OPEN_WINDOWS = 64
FAN = 64
END = 0  # id that closes every document
FRAME_TOKENS = 1 << 20  # tokens per emitted frame
END_OF_TEXT = "<|endoftext|>"  # fixed: the vocabulary's special token, one id where it stands in a text
PIECE = "doc_id string, start long, length long, ids binary, doc_tokens long"
PACKED = PIECE + ", part long, sequence_id long, offset long, sequence_tokens long"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken
    table = {base64.b64decode(token): int(n) for token, n in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table,
                             special_tokens={END_OF_TEXT: max(table.values()) + 1})


def encode(text: str | None, encoding) -> np.ndarray:
    """Ids of a whole text (NULL: empty) and the closing id."""
    ids = encoding.encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, END).astype("<u4")


class Windows:
    """At most ``limit`` open windows. ``add`` and ``finish`` return emitted
    sequences, lists of pieces ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ordered
        self.content: dict[int, list] = {}
        self.opened = 0

    def _put(self, piece, room: int, window: int, at: int | None):
        if at is not None:
            self.rooms.pop(at)
        self.content[window].append(piece)
        if room == len(piece[2]):
            return [self.content.pop(window)]
        bisect.insort(self.rooms, (room - len(piece[2]), window))
        return []

    def add(self, doc, start: int, ids: np.ndarray, total: int):
        out = []
        while len(ids) >= self.capacity:
            out.append([(doc, start, ids[:self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity:]
        while len(ids):
            best = bisect.bisect_left(self.rooms, (len(ids), -1))
            if best < len(self.rooms):
                room, window = self.rooms[best]
                return out + self._put((doc, start, ids, total), room, window, best)
            if len(self.rooms) < self.limit:
                self.opened += 1
                self.content[self.opened] = []
                return out + self._put((doc, start, ids, total), self.capacity, self.opened, None)
            room, window = self.rooms[0]  # the fullest
            out += self._put((doc, start, ids[:room], total), room, window, 0)
            start, ids = start + room, ids[room:]
        return out

    def leftovers(self):
        """The open windows, fullest first."""
        return [self.content[window] for _, window in self.rooms]

    def finish(self):
        """Fill the open windows from each other; the last tokens, fewer than
        a window, are cut at powers of two."""
        pieces = [p for window in self.leftovers() for p in window]
        left = sum(len(p[2]) for p in pieces)
        out, current, room = [], [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                if room == 0:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                current.append((doc, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if room == 0:
                    out.append(current)
                    current = []
        return out


def _rows(sequences, part: int, first: int | None):
    """Output rows of sequences numbered from ``first`` (``None``: leftovers)."""
    rows = []
    for k, pieces in enumerate(sequences):
        offset, used = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), ids.tobytes(), total, part,
                         None if first is None else first + k, offset, used))
            offset += len(ids)
    return rows


def _frame(rows) -> pd.DataFrame:
    fields = [f.split() for f in PACKED.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pd.DataFrame({name: pd.array(list(v), dtype="Int64") if kind == "long" else pd.Series(list(v), dtype="object")
                         for (name, kind), v in zip(fields, columns)})


def pack_windows(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                 open_windows: int = OPEN_WINDOWS, fan: int = FAN) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset,
    sequence_tokens``: one row per piece, ``ids`` its tokens as little-endian
    unsigned 32-bit numbers. ``docs`` needs ``doc_id, text``; other columns
    are ignored. ``vocabulary`` is the path of a byte-level BPE rank file on
    the driver (default: the installed ``byte_bpe_50k``).

    Every token of every row is in exactly one piece; a sequence is filled
    without gaps from offset 0 and holds ``capacity`` tokens (a power of two)
    or a smaller power of two. NULL and empty texts are documents of the
    closing id alone. NULL ids and repeated rows are packed like others. Of
    windows with equal room the one opened first is taken; which documents
    share a sequence depends on the partitioning of ``docs``. An empty table
    gives no rows."""
    import public_tokenizers
    spark = docs.sparkSession
    ship_package(spark)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))

    def pack(batches):
        encoding = _encoding(*ranks.value)
        part = TaskContext.get().partitionId()
        windows, done, rows, tokens = Windows(capacity, open_windows), part << 32, [], 0
        for frame in batches:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = encode(text, encoding)
                emitted = windows.add(doc, 0, ids, len(ids))
                rows += _rows(emitted, part, done)
                done, tokens = done + len(emitted), tokens + len(ids)
                if tokens >= FRAME_TOKENS:
                    if rows:
                        yield _frame(rows)
                    rows, tokens = [], 0
        rows += _rows(windows.leftovers(), part, None)
        if rows:
            yield _frame(rows)

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    first = materialize(named.mapInPandas(pack, PACKED))
    done, left, level = [first.filter("sequence_id IS NOT NULL")], first.filter("sequence_id IS NULL"), 0
    parts = left.agg(F.max("part")).first()[0]  # one number
    last = parts is None
    while not last:
        level += 1
        parts //= fan
        last = parts == 0
        merged = materialize(left.withColumn("part", F.expr(f"part div {int(fan)}")).groupBy("part")
                             .applyInPandas(_merger(capacity, open_windows, level, last), PACKED))
        done.append(merged.filter("sequence_id IS NOT NULL"))
        left = merged.filter("sequence_id IS NULL")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids", "doc_tokens",
                      "sequence_id", "offset", "sequence_tokens")


def _merger(capacity: int, open_windows: int, level: int, last: bool):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        frame = frame.assign(key=frame["doc_id"].fillna("")) \
            .sort_values(["length", "key", "start", "ids"], ascending=[False, True, True, True], kind="stable")
        windows, sequences = Windows(capacity, open_windows), []
        for doc, start, ids, total in zip(frame["doc_id"], frame["start"], frame["ids"], frame["doc_tokens"]):
            sequences += windows.add(doc, int(start), np.frombuffer(ids, dtype="<u4"), int(total))
        rows = []
        if last:
            sequences += windows.finish()
        else:
            rows = _rows(windows.leftovers(), part, None)
        return _frame(_rows(sequences, part, (level << 58) + (part << 32)) + rows)
    return merge


def piece_digests(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_tokens")
