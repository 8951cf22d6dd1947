"""D2 with an exact vocabulary: the cost of a word is the number of tokens of
``word + ' '`` under a given byte-level BPE rank file (one base64 token and its
rank per line). Nothing is trained here."""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def _costs(ranks: bytes, pattern: str) -> Callable[[str], int]:
    import tiktoken
    table = {base64.b64decode(token): int(n) for token, n in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @lru_cache(maxsize=1 << 16)  # words repeat; the cache is bounded
    def cost(word: str) -> int:
        return len(encoding.encode_ordinary(word + " "))
    return cost


def vocabulary_cost(path: str, pattern: str) -> Callable[[Sequence[str]], np.ndarray]:
    """``counter`` for the chunkers, from the rank file at ``path`` (read on
    the driver, shipped with the job) and its word pattern."""
    with open(path, "rb") as f:
        ranks = f.read()

    def counter(words: Sequence[str]) -> np.ndarray:
        from tessera.functions.token_costs import _costs
        return np.fromiter(map(_costs(ranks, pattern), words), dtype=np.int64, count=len(words))
    return counter
