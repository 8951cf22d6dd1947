"""D3 for documents of any size: greedy chunking spread over tasks.

The greedy packer is a machine whose state is the token count ``t`` of the open
chunk: a word of cost c closes the chunk if ``t + c > max``. A document is cut
into blocks of words. A block's effect is a map over all states ``0 ..
max_tokens + 1`` (the last stands for a single word over budget): the state
after the block and how many chunks it closed. In the block every state jumps
to its first chunk start, and the chunk starts jump to the next one, resolved
from the block's end.

Maps compose, so the states at all block borders are found by a tree: ``FAN``
neighbours are composed to one map, ``FAN`` of these to the next, until one is
left per document; from the start state the borders then come down the same
tree. With its border state every block cuts its own words, and the pieces of a
chunk that spans blocks are joined. No task sees more than one block of text,
or ``FAN`` maps, so the longest task does not grow with the document. The
result equals the sequential packer's, empty first chunk included.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.chunking import length_cost
from tessera.operators.indexing import FRAME_ROWS, MAX_TOKENS
from tessera.session import materialize, ship_package

FAN = 64
BLOCK_WORDS = 50_000
MAPS = "key string, block long, state binary, closed binary"
BORDERS = "key string, block long, at long, chunk_no long"


def _costs(words, counter) -> np.ndarray:
    return np.asarray((counter or length_cost)(words), dtype=np.int64)


def block_map(costs: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For every state before the block: the state after it and the number
    of chunks closed in it."""
    over = max_tokens + 1
    states = np.arange(over + 1)
    n = len(costs)
    if n == 0:
        return states, np.zeros(over + 1, dtype=np.int64)
    total = np.cumsum(costs)
    before = total - costs
    # chunk starts: where the next chunk starts, and what is left from each start at the end
    nxt = np.maximum(np.searchsorted(total, before + max_tokens, side="right"), np.arange(n) + 1)
    end_state, closes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for j in range(n - 1, -1, -1):
        k = nxt[j]
        if k >= n:
            end_state[j] = min(total[-1] - before[j], over)
        else:
            end_state[j], closes[j] = end_state[k], closes[k] + 1
    first = np.searchsorted(total, max_tokens - states, side="right")
    first[over] = 0  # a word over budget is alone
    stays = first >= n
    at = np.minimum(first, n - 1)
    return (np.where(stays, np.minimum(states + total[-1], over), end_state[at]), np.where(stays, 0, closes[at] + 1))


def cut_block(words: list[str], costs: np.ndarray, state: int, max_tokens: int) -> list[list[str]]:
    """The block's words by chunk: the first list goes on with the open chunk
    (it may be empty), each further one starts a chunk."""
    total = np.cumsum(costs)
    out, s, n = [], 0, len(words)
    e = 0 if state > max_tokens else int(np.searchsorted(total, max_tokens - state, side="right"))
    out.append(words[:e])
    s = e
    while s < n:
        base = total[s - 1] if s else 0
        e = max(int(np.searchsorted(total, base + max_tokens, side="right")), s + 1)
        out.append(words[s:e])
        s = e
    return out


def document_blocks(docs: DataFrame, key: str = "key", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(key, block, text)``: documents cut after every ``block_words`` words,
    numbered from 0. Keys have to be unique."""
    ship_package(docs.sparkSession)

    def run(batches):
        for frame in batches:
            for k, t in zip(frame["key"], frame["text"]):
                words = (t or "").split()
                for n in range(0, len(words), block_words):
                    yield pd.DataFrame({"key": [k], "block": [n // block_words], "text": [" ".join(words[n:n + block_words])]})
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, block long, text string")


def line_blocks(lines: DataFrame, block_bytes: int = 1 << 19) -> DataFrame:
    """``(key, block, text)`` from ``objects.read_object_lines``: consecutive
    lines of a range are joined to blocks of about ``block_bytes`` characters,
    numbered by their place in the object. No range is gathered: a task reads
    its lines in order."""
    ship_package(lines.sparkSession)

    def run(batches):
        key, start, at, size, held = None, None, 0, 0, []
        rows, waiting = [], 0

        def frame_of(rows):
            return pd.DataFrame(rows, columns=["key", "block", "text"])
        for frame in batches:
            for k, r, line in zip(frame["key"], frame["range"], frame["line"]):
                if (k, r) != (key, start) or size >= block_bytes:
                    if held:
                        rows.append((key, at, "\n".join(held)))
                        waiting += size
                        if waiting >= block_bytes or len(rows) >= FRAME_ROWS:
                            yield frame_of(rows)
                            rows, waiting = [], 0
                    at = int(r) if (k, r) != (key, start) else at + size
                    key, start, size, held = k, r, 0, []
                held.append(line)
                size += len(line) + 1
        if held:
            rows.append((key, at, "\n".join(held)))
        if rows:
            yield frame_of(rows)
    return lines.select("key", "range", "line").mapInPandas(run, "key string, block long, text string")


def _packed(array) -> bytes:
    return np.asarray(array, dtype="<i8").tobytes()


def _compose(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")
    state = closed = None
    for s, c in zip(frame["state"], frame["closed"]):
        s, c = np.frombuffer(s, dtype="<i8"), np.frombuffer(c, dtype="<i8")
        state, closed = (s, c) if state is None else (s[state], closed + c[state])
    return pd.DataFrame({"key": [frame["key"].iloc[0]], "block": [int(frame["up"].iloc[0])],
                         "state": [_packed(state)], "closed": [_packed(closed)]})


def _descend(maps: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    at, chunk_no = int(border["at"].iloc[0]), int(border["chunk_no"].iloc[0])
    rows = []
    maps = maps.sort_values("block")
    for k, b, s, c in zip(maps["key"], maps["block"], maps["state"], maps["closed"]):
        rows.append((k, b, at, chunk_no))
        chunk_no += int(np.frombuffer(c, dtype="<i8")[at])
        at = int(np.frombuffer(s, dtype="<i8")[at])
    return pd.DataFrame(rows, columns=["key", "block", "at", "chunk_no"])


def chunk_blocks(blocks: DataFrame, max_tokens: int = MAX_TOKENS, counter: Callable | None = None,
                 keep_empty_first: bool = True, fan: int = FAN) -> DataFrame:
    """``(key, chunk_no, chunk)`` as ``indexing.chunk_documents``, from blocks
    ``(key, block, text)`` that are ordered by ``block`` within their key (a
    number from 0; gaps do not matter). Blocks without words change nothing.
    ``counter(words) -> costs`` as there; costs are not negative."""
    spark = blocks.sparkSession
    ship_package(spark)
    blocks = materialize(blocks.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")))

    def maps(batches):
        most = max(1, (1 << 22) // (16 * (max_tokens + 2)))  # rows of about 4 MB of maps
        for frame in batches:
            rows = []
            for k, b, t in zip(frame["key"], frame["block"], frame["text"]):
                state, closed = block_map(_costs(t.split(), counter), max_tokens)
                rows.append((k, b, _packed(state), _packed(closed)))
                if len(rows) >= most:
                    yield pd.DataFrame(rows, columns=["key", "block", "state", "closed"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["key", "block", "state", "closed"])

    levels = [materialize(blocks.mapInPandas(maps, MAPS))]
    top = levels[0].agg(F.max("block")).first()[0]  # one number
    if top is None:
        return spark.createDataFrame([], "key string, chunk_no int, chunk string")
    while top > 0:
        top //= fan
        up = levels[-1].withColumn("up", F.expr(f"block div {int(fan)}"))
        levels.append(materialize(up.groupBy("key", "up").applyInPandas(_compose, MAPS)))
    borders = levels[-1].select("key", "block", F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("chunk_no"))
    for lower in reversed(levels[:-1]):
        below = lower.withColumn("up", F.expr(f"block div {int(fan)}"))
        named = borders.withColumnRenamed("block", "up")
        borders = materialize(below.groupBy("key", "up").cogroup(named.groupBy("key", "up"))
                              .applyInPandas(lambda m, b: _descend(m, b), BORDERS))

    def cut(batches):
        for frame in batches:
            rows = []
            for k, b, t, at, no in zip(*(frame[c] for c in ("key", "block", "text", "at", "chunk_no"))):
                words = t.split()
                for i, piece in enumerate(cut_block(words, _costs(words, counter), int(at), max_tokens)):
                    if piece or (no + i == 1):  # the first chunk may be empty, others never are
                        rows.append((k, int(no + i), int(b), " ".join(piece)))
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "block", "piece"])
    pieces = blocks.join(borders, ["key", "block"]).mapInPandas(cut, "key string, chunk_no int, block long, piece string")
    ordered = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), lambda x: x != "")
    chunks = pieces.groupBy("key", "chunk_no").agg(F.array_join(ordered, " ").alias("chunk"))
    if not keep_empty_first:
        empty = chunks.filter("chunk = ''").select("key", F.lit(1).alias("less"))
        chunks = (chunks.filter("chunk <> ''").join(empty, "key", "left")
                  .select("key", (F.col("chunk_no") - F.coalesce("less", F.lit(0))).alias("chunk_no"), "chunk"))
    return chunks
