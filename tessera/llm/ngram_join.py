"""N-gram Jaccard join with signature trees.

A document's set is its distinct 5-word shingles (64-bit hashes). Two sets
link when ``100 * |A & B| >= 80 * |A | B|``. Equal sets collapse to one member
first.

Roots. In any common order of tokens, two linked sets share at least ``l`` of
their first ``n - ceil(0.8 n) + l`` tokens. Every token of such a prefix (``l``
grows with ``n``) is the root of one signature tree over the members that have
it there, and a member whose prefix tokens meet too few size-compatible others
links with nothing and leaves all trees. The order puts shingles that are
frequent in the corpus last, which keeps trees small.

Trees. Below a root, members hang under inner nodes. Every node holds the OR
of its members' token bitmaps, their size range and the largest number of
bitmap collisions in one member. Two nodes can only hold a link if

    popcount(U & V) + collisions  >=  4/9 * (smallest size in U + in V)

and their size ranges overlap within 0.8. The first descent compares each
member with its tree's pivot (smallest member); linked members form classes.
Trees with the same pivot are then hung under one root. The second descent
traverses, in every such tree that still has several classes, pairs of nodes of
different classes top down and prunes by the bound; pairs inside a class are
never looked at, and a link joins its classes at once. Surviving leaf pairs
are verified exactly on the sets. So all classes are found, and a group of
thousands of near copies costs a few comparisons per member.

A root with many members is cut into blocks of ``BLOCK`` members by size;
block pairs whose size ranges cannot link are dropped, the others are traversed
by different tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bits import build_filter, may_contain
from tessera.llm.components import connected_components
from tessera.llm.text import byte_words, shingle_hashes, word_hashes
from tessera.session import materialize, ship_package

WIDTH = 5
HOT_TOKENS = 1 << 16
FILTER_BITS = 1 << 24
BLOCK = 512
FANOUT = 8
SHARE = 20
SEEN = 1 << 18


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; one for a text of fewer than
    ``WIDTH`` words, none without words."""
    ws = byte_words(text, lower=True)
    if not ws:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingle_hashes(word_hashes(ws), min(WIDTH, len(ws))) + np.uint64(len(ws) < WIDTH) * np.uint64(len(ws)))


def member_id(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128-bit digest of a set as two signed numbers, the second cut to
    ``bits`` bits."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True) >> (64 - bits)


def member_name(s: np.ndarray, taken: frozenset, bits: int) -> int:
    """Name of a set in all joins: the second half of its digest, or the first
    where several sets have that second half (``taken``)."""
    high, low = member_id(s, bits)
    return high if low in taken else low


def shared_at_least(n: int) -> int:
    """``l``: tokens that the prefixes of a set of ``n`` and of a linked set
    share, if the other's is at least as large."""
    return 1 + n // SHARE


def prefix_length(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + shared_at_least(n))


def prefix(s: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First tokens of a set in the order (corpus count if hot, hash)."""
    k = prefix_length(len(s))
    if not len(hot):
        return s[:k]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    rare = s[~is_hot]
    if len(rare) >= k:
        return rare[:k]
    common, c = s[is_hot], counts[at[is_hot]]
    return np.concatenate([rare, common[np.argsort(c, kind="stable")][:k - len(rare)]])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Token bitmap of 8 to 16 bits per token (at least 64 bits) as words."""
    bits = max(64, 1 << (8 * len(s) - 1).bit_length())
    out = np.zeros(bits // 64, dtype=np.uint64)
    b = s & np.uint64(bits - 1)
    np.bitwise_or.at(out, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1).astype(np.int64)


def _survey(frames, bits):
    """Per document its set size and member id; per batch the shingles that
    recur in it (kind 1)."""
    for f in frames:
        ids, sizes, hi, lo, sets = [], [], [], [], []
        held, held_size = [], 0
        for doc_id, text in zip(f["doc_id"], f["text"]):
            s = shingle_set(text)
            a, b = member_id(s, bits) if len(s) else (None, None)
            ids.append(doc_id if isinstance(doc_id, str) else None), sizes.append(len(s)), hi.append(a), lo.append(b)
            held.append(s)
            held_size += len(s)
            if held_size > 1 << 21:
                sets.append((len(held), np.concatenate(held)))
                held, held_size = [], 0
        sets.append((len(held), np.concatenate(held) if held else np.empty(0, np.uint64)))
        yield pd.DataFrame({"kind": 0, "doc_id": pd.Series(ids, dtype=object), "text_hash": f["text_hash"].to_numpy(), "n": sizes,
                            "member": pd.array(lo, "Int64"), "check": pd.array(hi, "Int64"), "copies": 1})
        for docs, all_ in sets:
            token, count = np.unique(all_, return_counts=True)
            keep = count >= max(3, docs // 400)
            yield pd.DataFrame({"kind": 1, "doc_id": pd.Series([None] * int(keep.sum()), dtype=object), "text_hash": 0,
                                "n": 0, "member": token[keep].view(np.int64), "check": 0, "copies": count[keep]})


def survey(docs: DataFrame, bits: int = 64) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInPandas(
        lambda frames: _survey(frames, bits),
        "kind int, doc_id string, text_hash long, n long, member long, check long, copies long")
    return materialize(rows.withColumn("doc_id", F.col("doc_id").cast("long")))


def _clashes(found: DataFrame) -> DataFrame:
    """Ids that several sets have (the other half of their digests differs)."""
    return (found.filter("n > 0").groupBy("member").agg(F.min("check").alias("x"), F.max("check").alias("y"))
            .filter("x <> y").select("member"))


def name_members(found: DataFrame) -> tuple[DataFrame, frozenset]:
    """``found`` with members under names that no two sets share, and the ids
    that are not used as names. Of N sets about N^2 / 2^65 ids clash (some 70
    at 5e10 sets), so few reach the driver; that a first half equals another
    set's name as well has a chance of 70 N / 2^64 there, and is an error."""
    taken = frozenset(r["member"] for r in _clashes(found).collect())
    if taken:
        found = found.withColumn("member", F.when(F.col("member").isin(list(taken)), F.col("check")).otherwise(F.col("member")))
        if not _clashes(found).isEmpty():
            raise ValueError("two different sets share both halves of their ids")
    return found, taken


def hot_tokens(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``HOT_TOKENS`` most frequent shingles with their counts. They only
    set the order of tokens; any order gives the same links."""
    top = (rows.filter("kind = 1").groupBy("member").agg(F.sum("copies").alias("copies"))
           .orderBy(F.col("copies").desc(), "member").limit(HOT_TOKENS).toPandas())
    token = top["member"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["copies"].to_numpy(dtype=np.int64)[order]


def postings(docs: DataFrame, hot, taken: frozenset, bits: int) -> DataFrame:
    """``token, member, n`` for the prefix tokens of every set. A set that its
    task has had before (of the last ``SEEN`` ones at least) is passed over, so
    copies in one task are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(frames):
        seen = set()
        for f in frames:
            tokens, members, sizes = [], [], []
            for text in f["text"]:
                s = shingle_set(text)
                m = member_name(s, taken, bits) if len(s) else None
                if len(s) and m not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(m)
                    p = prefix(s, *shared.value)
                    tokens.append(p)
                    members.append(np.full(len(p), m, dtype=np.int64))
                    sizes.append(np.full(len(p), len(s), dtype=np.int32))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "member": np.concatenate(members),
                                    "n": np.concatenate(sizes)})
    return docs.select("text").mapInPandas(emit, "token long, member long, n int")


def _enough(t: DataFrame) -> DataFrame:
    """Drop members with fewer shared tokens than a link needs (the partner
    may be as small as ``ceil(0.8 n)``)."""
    few = (t.groupBy("member", "n").agg(F.count(F.lit(1)).alias("c"))
           .filter(f"c >= 1 + ((4 * n + 4) DIV 5) DIV {SHARE}").select("member"))
    return t.join(few, "member")


def _size_compatible(t: DataFrame) -> DataFrame:
    """Per root, members whose neighbour in size order allows a link (if no
    neighbour's size does, nobody's does)."""
    by_size = Window.partitionBy("token").orderBy("n", "member")
    return (t.withColumn("before", F.lag("n").over(by_size)).withColumn("after", F.lead("n").over(by_size))
            .filter("100 * before >= 80 * n OR 100 * n >= 80 * after").drop("before", "after"))


def trees(posts: DataFrame) -> DataFrame:
    """Roots with at least two members: ``token, member, n, pivot, pivot_n``.
    The prefix tokens are shuffled once, by token: that also brings copies
    together."""
    t = materialize(_size_compatible(posts.repartition("token").distinct()))
    t = _size_compatible(_enough(t).select("token", "member", "n"))
    t = _enough(t).withColumn("first", F.min(F.struct("member", "n")).over(Window.partitionBy("token")))
    return t.select("token", "member", "n", F.col("first.member").alias("pivot"), F.col("first.n").alias("pivot_n"))


def member_sets(docs: DataFrame, members: DataFrame, taken: frozenset, bits: int) -> DataFrame:
    """``member, n, tokens`` of the given members, computed again from the
    texts. A filter of ``FILTER_BITS`` bits (fixed size) keeps most other sets
    from leaving their task; the join behind it is exact."""
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(members, F.col("member"), FILTER_BITS))

    def emit(frames):
        for f in frames:
            rows, size = [], 0
            for text in f["text"]:
                s = shingle_set(text)
                if not len(s):
                    continue
                m = member_name(s, taken, bits)
                if may_contain(shared.value, np.array([m]))[0]:
                    rows.append((m, len(s), s.view(np.int64)))
                    size += len(s)
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=["member", "n", "tokens"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["member", "n", "tokens"])
    sets = docs.select("text").mapInPandas(emit, "member long, n int, tokens array<long>")
    return materialize(sets.join(members, "member", "left_semi").dropDuplicates(["member"]))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``src, dst`` of the pairs (a, b) that link."""
    a = sets.select(F.col("member").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    b = sets.select(F.col("member").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    common = F.size(F.array_intersect("at", "bt"))
    j = pairs.join(a, "a").join(b, "b").withColumn("common", common)
    return j.filter(100 * F.col("common") >= 80 * (F.col("an") + F.col("bn") - F.col("common"))) \
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))


class Node:
    """Inner node or leaf of a signature tree over rows ``lo .. hi`` of the
    level-ordered member table."""

    __slots__ = ("lo", "hi", "bits", "small", "large", "loss", "below", "label")

    def __init__(self, lo, hi, bits, small, large, loss, below, label):
        self.lo, self.hi, self.bits, self.small, self.large = lo, hi, bits, small, large
        self.loss, self.below, self.label = loss, below, label


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap reduced to ``size`` words (lower bits of a hash stay)."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def build_tree(sizes, labels, bitmaps, order) -> Node:
    """Tree over the members in ``order`` (sorted by class and size, so that
    ORs stay selective), ``FANOUT`` children per node."""
    def leaf(k):
        b, n = bitmaps[k], int(sizes[k])
        return Node(k, k + 1, b, n, n, n - int(_popcount(b)), (), labels[k])

    level = [leaf(k) for k in order]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FANOUT):
            kids = level[i:i + FANOUT]
            width = min(len(x.bits) for x in kids)
            bits = np.bitwise_or.reduce([fold(x.bits, width) for x in kids], axis=0)
            label = kids[0].label if all(x.label == kids[0].label for x in kids) else None
            # folding adds collisions, at most the bits it merges in one member
            loss = max(x.loss + (int(_popcount(x.bits)) - int(_popcount(fold(x.bits, width)))
                                 if len(x.bits) > width else 0) for x in kids)
            above.append(Node(kids[0].lo, kids[-1].hi, bits, min(x.small for x in kids), max(x.large for x in kids),
                              loss, kids, label))
        level = above
    return level[0]


def may_link(u: Node, v: Node) -> bool:
    """Can any member of ``u`` link with any member of ``v``?"""
    if u.label is not None and u.label == v.label:
        return False
    if 100 * u.large < 80 * v.small or 100 * v.large < 80 * u.small:
        return False
    width = min(len(u.bits), len(v.bits))
    a, b = fold(u.bits, width), fold(v.bits, width)
    loss_u = u.loss + (int(_popcount(u.bits) - _popcount(a)) if len(u.bits) > width else 0)
    loss_v = v.loss + (int(_popcount(v.bits) - _popcount(b)) if len(v.bits) > width else 0)
    most = int(_popcount(a & b)) + min(loss_u, loss_v)
    return 9 * min(most, u.large, v.large) >= 4 * (u.small + v.small)


def traverse(u: Node, v: Node):
    """Leaf pairs (row numbers) of two trees, or of one tree with itself, that
    the bounds cannot rule out."""
    todo = [(u, v)]
    while todo:
        u, v = todo.pop()
        if u is v:
            if u.label is None:
                kids = u.below
                todo += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif may_link(u, v):
            if not u.below and not v.below:
                yield u.lo, v.lo
            elif len(v.below) == 0 or (u.below and u.hi - u.lo >= v.hi - v.lo):
                todo += [(x, v) for x in u.below]
            else:
                todo += [(u, x) for x in v.below]


def groups_of(frames, keys):
    """Consecutive groups of sorted batches, as lists of rows; a group may
    span batches."""
    held, key = [], None
    for f in frames:
        for row in f.itertuples(index=False):
            k = tuple(getattr(row, c) for c in keys)
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


class Classes:
    """Union-find over the rows of one task."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_of_task(rows) -> list[tuple[int, int]]:
    """Links between different classes in one task: one block with itself, or
    two blocks. Pairs whose classes a link has joined already are passed
    over, so at most one link per row is returned."""
    sizes, labels = [r.n for r in rows], [r.label for r in rows]
    sets = [np.asarray(r.tokens).view(np.uint64) for r in rows]
    bitmaps = [bitmap(s) for s in sets]
    classes = Classes(labels)
    sides = []
    for side in (0, 1):
        order = sorted((k for k, r in enumerate(rows) if r.side == side), key=lambda k: (labels[k], sizes[k], rows[k].member))
        if order:
            sides.append(build_tree(sizes, labels, bitmaps, order))
    found = []
    for x, y in traverse(sides[0], sides[-1]):
        if classes.find(x) != classes.find(y):
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= 80 * (sizes[x] + sizes[y] - common) and classes.join(x, y):
                found.append((rows[x].member, rows[y].member))
    return found


def _descend(frames):
    for _, rows in groups_of(frames, ("pivot", "i", "j")):
        found = links_of_task(rows)
        if found:
            yield pd.DataFrame(found, columns=["src", "dst"])


def second_descent(t: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of different classes, ``src, dst`` (enough of
    them to join the classes). Trees with the same pivot are one tree here,
    so a family of near copies is traversed about once."""
    label = labels.select(F.col("node").alias("member"), "label")
    own = Window.partitionBy("pivot")
    r = (t.select("pivot", "member", "n").distinct().join(label, "member", "left")
         .select("pivot", "member", "n", F.coalesce("label", "member").alias("label"))
         .withColumn("lo", F.min("label").over(own)).withColumn("hi", F.max("label").over(own))
         .withColumn("c", F.count(F.lit(1)).over(own)).filter("lo <> hi").drop("lo", "hi"))
    rank = F.row_number().over(own.orderBy("n", "member")) - 1
    r = materialize(r.withColumn("block", F.when(F.col("c") <= BLOCK, F.lit(0)).otherwise(F.floor(rank / BLOCK)).cast("int")))
    big = r.filter(F.col("c") > BLOCK).groupBy("pivot", "block").agg(
        F.min("n").alias("small"), F.max("n").alias("large"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    u = big.select("pivot", F.col("block").alias("i"), F.col("large").alias("ul"), F.col("l0").alias("u0"), F.col("l1").alias("u1"))
    v = big.select("pivot", F.col("block").alias("j"), F.col("small").alias("vs"), F.col("l0").alias("v0"), F.col("l1").alias("v1"))
    tasks = (u.join(v, "pivot").filter("i <= j AND 100 * ul >= 80 * vs AND NOT (u0 = u1 AND v0 = v1 AND u0 = v0)")
             .select("pivot", "i", "j"))
    sides = tasks.select("pivot", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(
        F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(
            F.struct(F.col("i").alias("block"), F.lit(0).alias("side")),
            F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("x")).select("pivot", "i", "j", "x.*")
    small = r.filter(F.col("c") <= BLOCK).select("pivot", F.lit(0).alias("i"), F.lit(0).alias("j"), "member", "n", "label",
                                                 F.lit(0).alias("side"))
    large = r.filter(F.col("c") > BLOCK).join(sides, ["pivot", "block"]).select("pivot", "i", "j", "member", "n", "label", "side")
    dealt = (small.unionByName(large).join(sets.select("member", "tokens"), "member")
             .repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j"))
    return dealt.mapInPandas(_descend, "src long, dst long")


def _classes(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``found`` (one row per document: ``doc_id, text_hash, n, member``), the
    links between members and the label of every linked member."""
    ship_package(docs.sparkSession)
    rows = survey(docs, bits)
    found, taken = name_members(rows.filter("kind = 0"))
    t = materialize(trees(postings(docs, hot_tokens(rows), taken, bits)))
    sets = member_sets(docs, t.select("member").distinct(), taken, bits)
    stars = (t.filter("member <> pivot AND 100 * least(n, pivot_n) >= 80 * greatest(n, pivot_n)")
             .select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct())
    links = materialize(verify(stars, sets))
    labels = connected_components(links)
    more = materialize(second_descent(t, labels, sets))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = connected_components(links)
    return found, links, labels


def class_heads(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The documents to keep if one of each class of near duplicates stays:
    ``doc_id, text_hash`` (``xxhash64`` of the text) and ``copies``, the rows
    that have both. A document is its id with its text here, so rows that
    share an id without being near duplicates are kept apart. The head of a
    class is its smallest id, then text hash. Texts without words are in no
    class, each of their rows is its own head; so are rows with a NULL id. An
    empty table gives no rows."""
    found, _, labels = _classes(docs, bits)
    own = found.filter("n > 0 AND doc_id IS NOT NULL")
    first = (own.groupBy("member", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
             .groupBy("member").agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("head")))
    by_label = labels.select(F.col("node").alias("member"), "label")
    heads = (first.join(by_label, "member", "left").groupBy(F.coalesce("label", "member").alias("label"))
             .agg(F.min("head").alias("head")).select("head.*"))
    return heads.unionByName(found.filter("n = 0 OR doc_id IS NULL")
                             .select("doc_id", "text_hash", F.lit(1).cast("long").alias("copies")))


def jaccard_components(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (needs
    ``doc_id, text``; other columns are ignored).

    Texts without words have 0 shingles and link with nothing. Rows with a
    NULL id have a NULL component and link nothing to others by themselves;
    rows that share an id are one document. An empty table gives no rows.
    Results do not depend on ``bits``, the length of a set's usual id: sets
    whose ids clash go by the other half of their 128-bit digest."""
    found, links, labels = _classes(docs, bits)
    members = found.filter("n > 0 AND doc_id IS NOT NULL").select("member", "doc_id").distinct()
    by_label = labels.select(F.col("node").alias("member"), "label")
    # rows that share an id join their members
    shared = members.groupBy("doc_id").agg(F.min("member").alias("a"), F.max("member").alias("b")).filter("a <> b")
    if not shared.isEmpty():
        extra = members.join(shared, "doc_id").select(F.col("a").alias("src"), F.col("member").alias("dst"))
        by_label = connected_components(links.unionByName(extra)).select(F.col("node").alias("member"), "label")
    first = (members.groupBy("member").agg(F.min("doc_id").alias("first")).join(by_label, "member", "left")
             .select("member", "first", F.coalesce("label", "member").alias("label")))
    smallest = first.groupBy("label").agg(F.min("first").alias("component"))
    component = first.join(smallest, "label").select("member", "component")
    return (found.join(component, "member", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
                    .cast("long").alias("component_id")))
