"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs become a set of 64-bit digests. A line is cut after words
that their own hash chooses (on average every 24 words), so an insertion changes
the pieces around it and no others; shorter texts add the finer cuts of
``SCALES``, so they share pieces with an edited version too. A stretch without
chosen words is cut on a grid. The sketch has
``CELLS`` cells in three parts; every digest is
added to one cell of each part (count, XOR of digests, XOR of check sums). The
sketches of two versions are subtracted cell by cell, so common paragraphs
cancel, and peeling recovers the digests that differ: a cell that holds a
single digest (count +-1 and a fitting check sum) gives it away, it is taken
out of its other cells, and so on. If cells remain, the sketch was too small:
the digests are dealt to more sketches of the same size by a fresh hash (a
larger sketch in total), and each part that fails again is retried larger. The
likeness is the Jaccard index that follows from the numbers of paragraphs and
of recovered differences.

SQL functions only. The one shuffle of the texts brings each next to its
successor: ids are cut into at most ``256 * FINE`` ranges, ordered inside a
range, and the first document of each range is handed to the range before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

TOKEN = "\\S{1,40}\\s*|\\s+"  # a word with the blanks after it
# Average words per piece, grid in words, for texts of fewer characters than this.
SCALES = ((24, 384, 1 << 31), (6, 30, 1500), (1, 1, 400))
PART = 6
CELLS = 3 * PART
ROUNDS = 8
SHARE = 6  # expected differences per sketch on a retry
MOST_PARTS = 48  # sketches per failed one and retry
COARSE, FINE = 256, 64
RANGE_CHARS = 2_000_000
MAX_LEVEL = 16


def _pieces(w: str, words: int, grid: int) -> str:
    """SQL: digests of the pieces of token array ``w``."""
    ends = (f"filter(transform({w}, (x, i) -> IF(i + 1 = size({w}) OR contains(x, '\\n') OR pmod(xxhash64(x), {words}) = 0 "
            f"OR (i + 1) % {grid} = 0, i + 1, 0)), e -> e > 0)")
    before = "IF(j = 0, 0, element_at(ends, j))"
    return (f"transform(array({ends}), ends -> transform(ends, (e, j) -> "
            f"xxhash64(slice({w}, {before} + 1, e - {before}))))[0]")


def digests(text: str) -> str:
    """SQL: distinct paragraph digests of a text."""
    none = "CAST(array() AS ARRAY<BIGINT>)"
    tokens = f"regexp_extract_all({text}, '{TOKEN}', 0)".replace("\\", "\\\\")
    scales = ", ".join(f"IF(char_length({text}) < {chars}L, {_pieces('w', words, grid)}, {none})" for words, grid, chars in SCALES)
    return f"transform(array({tokens}), w -> IF(size(w) = 0, {none}, array_distinct(concat({scales}))))[0]"


def _entry(k: str, level: str) -> str:
    h = f"xxhash64({k}, {level})"
    cells = ", ".join(f"CAST({j * PART} + pmod(shiftright({h}, {20 * j}), {PART}) AS INT) AS c{j}" for j in range(3))
    return f"{cells}, {_check(k)} AS h"


def _check(k: str) -> str:
    return f"(xxhash64({k}, 'check') & 4294967295L)"


def _hits(x: str, i: str) -> str:
    return f"({x}.c0 = {i} OR {x}.c1 = {i} OR {x}.c2 = {i})"


def sketch(keys: str, level: str) -> str:
    """SQL: the cells (n, k, h) of a digest array."""
    def part(j):
        return (f"transform(sequence({j * PART}, {(j + 1) * PART - 1}), i -> aggregate(filter(z, x -> x.c{j} = i), "
                f"struct(0L AS n, 0L AS k, 0L AS h), (s, x) -> struct(s.n + 1L AS n, s.k ^ x.k AS k, s.h ^ x.h AS h)))")
    return (f"transform(array(transform({keys}, k -> struct(k AS k, {_entry('k', level)}))), "
            f"z -> concat({part(0)}, {part(1)}, {part(2)}))[0]")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.n - y.n AS n, x.k ^ y.k AS k, x.h ^ y.h AS h))"


def difference(a: str, b: str, level: str) -> str:
    """SQL: the cells of ``a``'s sketch less ``b``'s, made in one pass over
    both: counts of ``b`` are negative, XOR has no sign."""
    def part(j):
        return (f"transform(sequence({j * PART}, {(j + 1) * PART - 1}), i -> aggregate(filter(z, x -> x.c{j} = i), "
                f"struct(0L AS n, 0L AS k, 0L AS h), (s, x) -> struct(s.n + x.sign AS n, s.k ^ x.k AS k, s.h ^ x.h AS h)))")

    def entries(keys, sign):
        return f"transform({keys}, k -> struct(k AS k, {sign}L AS sign, {_entry('k', level)}))"
    return f"transform(array(concat({entries(a, 1)}, {entries(b, -1)})), z -> concat({part(0)}, {part(1)}, {part(2)}))[0]"


def peel(cells: str, level: str) -> str:
    """SQL: ``struct(ok, found)`` of a difference sketch. A round that finds no
    pure cell is the last."""
    pure = (f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND {_check('c.k')} = c.h), "
            f"c -> struct(c.k AS k, c.n AS sign, {_entry('c.k', level)})))")
    clear = (f"transform(s.cells, (c, i) -> aggregate(filter(p, x -> {_hits('x', 'i')}), c, "
             f"(q, x) -> struct(q.n - x.sign AS n, q.k ^ x.k AS k, q.h ^ x.h AS h)))")
    step = (f"IF(s.done, s, transform(array({pure}), p -> IF(size(p) = 0, struct(s.cells AS cells, s.found AS found, true AS done), "
            f"struct({clear} AS cells, s.found + CAST(size(p) AS BIGINT) AS found, false AS done)))[0])")
    return f"""aggregate(sequence(1, {ROUNDS}), struct({cells} AS cells, 0L AS found, false AS done), (s, r) -> {step},
        s -> struct(forall(s.cells, c -> c.n = 0 AND c.k = 0 AND c.h = 0) AS ok, s.found AS found))"""


def printed(cells: str, keys: str) -> str:
    """SQL: a sketch as text, number of paragraphs first."""
    cell = "concat(hex(c.n), '.', hex(c.k), '.', hex(c.h))"
    return f"concat(CAST(size({keys}) AS STRING), ':', array_join(transform({cells}, c -> {cell}), ','))"


def _ranges(docs: DataFrame):
    """Column that numbers ranges of ``doc_id`` (0: NULL ids), ascending.
    Quantiles of the ids bound the coarse ranges, equal widths the fine ones;
    both only balance the work."""
    stats = docs.agg(F.percentile_approx("doc_id", [k / COARSE for k in range(COARSE + 1)], 10_000).alias("q"),
                     F.sum(F.char_length("text")).alias("chars")).first()
    if not stats["q"]:
        return F.lit(0).cast("long")
    wanted = max(1, min(COARSE * FINE, int(stats["chars"] or 0) // RANGE_CHARS))
    coarse = min(COARSE, wanted)
    fine = -(-wanted // coarse)
    q = sorted({stats["q"][k * COARSE // coarse] for k in range(coarse + 1)})
    bounds = F.array(*[F.lit(x) for x in q])
    slot = F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    low, high = F.element_at(bounds, slot), F.element_at(bounds, F.least(slot + 1, F.size(bounds)))
    inside = F.floor((F.col("doc_id") - low) * fine / F.greatest(high - low, F.lit(1)))
    part = F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(slot * fine + part + 1).cast("long")


def with_successor(docs: DataFrame) -> DataFrame:
    """``doc_id, t, next_t``: every text with that of the next document in
    descending id order (the first follows the last; NULL ids come last, equal
    ids are ordered by text hash)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), _ranges(docs).alias("range"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("t")]
    inside = Window.partitionBy("range").orderBy(*order)
    rank = F.struct((-F.coalesce("doc_id", F.lit(0))).alias("a"), F.xxhash64("t").alias("b"))
    heads = rows.groupBy("range").agg(F.min_by("t", rank).alias("head"))
    heads = materialize(heads)
    every = Window.orderBy(F.col("range").desc())
    whole = Window.partitionBy(F.lit(0))
    follow = heads.select("range", F.coalesce(F.lead("range").over(every), F.max("range").over(whole)).alias("after"))
    border = (follow.join(heads.select(F.col("range").alias("after"), "head"), "after")
              .select("range", F.col("head").alias("border_t")))
    placed = rows.withColumn("next_t", F.lead("t").over(inside))
    return (placed.join(border, "range")
            .select("doc_id", "t", F.coalesce("next_t", "border_t").alias("next_t")))


def _deal(a: str, b: str, level: int) -> str:
    """SQL: the digests of a failed sketch dealt to several, ``a, b`` each.
    Every digest is hashed to its sketch once."""
    parts = f"CAST(least({MOST_PARTS}, greatest(4, ceil((size({a}) + size({b})) / {SHARE}))) AS INT)"

    def placed(x):
        return f"transform({x}, k -> struct(CAST(pmod(xxhash64(k, 'deal', {level}), n) AS INT) AS i, k AS k))"

    def own(x):
        return f"transform(filter({x}, y -> y.i = j), y -> y.k)"
    return (f"transform(array({parts}), n -> transform(array(struct({placed(a)} AS a, {placed(b)} AS b)), "
            f"d -> transform(sequence(0, n - 1), j -> struct({own('d.a')} AS a, {own('d.b')} AS b)))[0])[0]")


def _retried(ok: str, a: str, b: str) -> str:
    """SQL: ``a, b, p`` (what peeled) of the first retry's sketches; NULL where
    the sketch before had peeled."""
    cells = difference("t.a", "t.b", "1")
    return f"IF({ok}, NULL, transform({_deal(a, b, 1)}, t -> struct(t.a AS a, t.b AS b, {peel(cells, '1')} AS p)))"


def differences(pairs: DataFrame) -> DataFrame:
    """``row, kind, found``: recovered differences of the digest arrays ``a``
    and ``b`` of every (row, kind) left after the first retry, which is made
    beside the first sketches: few digests are written or come here."""
    solved, failed = [], pairs
    for level in range(2, MAX_LEVEL):
        lv = f"{level}"
        todo = failed.select("row", "kind", F.explode(F.expr(_deal("a", "b", level))).alias("x")).select("row", "kind", "x.a", "x.b")
        got = todo.select("row", "kind", "a", "b", F.expr(difference("a", "b", lv)).alias("cells"))
        got = got.select("row", "kind", "a", "b", F.expr(peel("cells", lv)).alias("p"))
        got = materialize(got.select("row", "kind", "p.ok", "p.found", F.when(~F.col("p.ok"), F.col("a")).alias("a"),
                                     F.when(~F.col("p.ok"), F.col("b")).alias("b")))
        solved.append(got.filter("ok").select("row", "kind", "found"))
        failed = got.filter("NOT ok").select("row", "kind", "a", "b")
        if failed.isEmpty():
            break
    else:
        raise RuntimeError("sketches kept failing to peel")
    out = solved[0]
    for s in solved[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "kind").agg(F.sum("found").alias("found"))


def _likeness(d, n, m):
    common = (n + m - d) / 2
    return F.when(n + m == 0, F.lit(1.0)).otherwise(F.round(common / (n + m - common), 6))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` for every row of ``docs`` (needs ``doc_id,
    text``; other columns are ignored).

    The edited text has the last third of the code points replaced by as many
    from the start of the next document. NULL text is empty (n_chars 0, no
    paragraphs); two texts without paragraphs have likeness 1. A single
    document is its own successor. An empty table gives no rows."""
    n = F.col("n_chars")
    third = F.floor(n / 3).cast("int")
    v = with_successor(docs).withColumn("n_chars", F.char_length("t").cast("long"))
    v = v.withColumn("edited", F.concat(F.substring("t", F.lit(1), (n - third).cast("int")),
                                        F.substring("next_t", F.lit(1), third)))
    v = v.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(digests("t")).alias("own"),
                 F.expr(digests("edited")).alias("changed"), F.expr(digests("next_t")).alias("after"))
    v = v.select("*", *[F.expr(sketch(c, "0")).alias(s) for c, s in (("own", "s0"), ("changed", "s1"), ("after", "s2"))])
    v = v.select("*", F.expr(peel(subtract("s0", "s1"), "0")).alias("edit"), F.expr(peel(subtract("s0", "s2"), "0")).alias("next"))
    v = v.select("*", F.expr(_retried("edit.ok", "own", "changed")).alias("edits"), F.expr(_retried("next.ok", "own", "after")).alias("nexts"))

    def peeled(x):
        return F.expr(f"IF({x}.ok, {x}.found, aggregate(filter({x}s, t -> t.p.ok), 0L, (s, t) -> s + t.p.found))")

    def left(x):
        return F.expr(f"transform(filter({x}s, t -> NOT t.p.ok), t -> struct('{'edited' if x == 'edit' else 'next'}' AS kind, t.a AS a, t.b AS b))")
    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, a: ARRAY<BIGINT>, b: ARRAY<BIGINT>>>)")
    first = materialize(v.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n0"),
        F.size("changed").alias("n1"), F.size("after").alias("n2"), F.expr(printed("s0", "own")).alias("fingerprint"),
        F.expr(printed("s1", "changed")).alias("edited_fingerprint"), peeled("edit").alias("d_edited"), peeled("next").alias("d_next"),
        F.concat(F.coalesce(left("edit"), nothing), F.coalesce(left("next"), nothing)).alias("left")))
    pairs = first.select("row", F.explode("left").alias("x")).select("row", "x.kind", "x.a", "x.b")
    found = differences(pairs).groupBy("row").agg(
        F.sum(F.when(F.col("kind") == "edited", F.col("found"))).alias("more_edited"),
        F.sum(F.when(F.col("kind") == "next", F.col("found"))).alias("more_next"))
    none = F.lit(0).cast("long")
    return first.join(found, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _likeness(F.col("d_edited") + F.coalesce("more_edited", none), F.col("n0"), F.col("n1")).alias("near_edited"),
        _likeness(F.col("d_next") + F.coalesce("more_next", none), F.col("n0"), F.col("n2")).alias("near_next"))
