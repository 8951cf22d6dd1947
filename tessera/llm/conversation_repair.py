"""Conversation structure repair with a suffix-shared automaton.

Every turn is reduced to one symbol: its role initial and whether it must be
deleted (blank, duplicate) or is truncated. A conversation's symbols are its
signature. Signatures are minimised from the end: sorted by their reversed
form, neighbours share the nodes of their common ending, and each node (an
ending of some signature) gets its cost-to-go and its best first edit per
grammar state once, for all conversations with that ending. Endings whose
cost-to-go differs by a constant only share one table. The cheapest audit of a
conversation is read off by walking from its node; edits that tie in cost
begin with different letters, so the smallest letter decides and no audits are
compared.

Distribution. Only symbols, turns and text digests travel to build signatures:
rows are range-partitioned by (conversation, turn, role, digest) and every
partition gives one slice per conversation, so a conversation that holds a
third of all rows is spread over many tasks. Duplicates inside a slice
are seen there; only a partition's first and last conversation can go on
elsewhere, and their first occurrences are compared by one grouped minimum.
Slices are joined to signatures (one character a turn), and the automaton runs
over range partitions of the reversed signatures. Texts are shuffled
once, by conversation, to replay the audit; they stream through the task in
turn order and are never gathered. (A SHA-256 of one conversation is a
sequential computation, so one task hashes it.)
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import BLANK_CHARS
from tessera.session import materialize, ship_package

# Fixed values of the contract: edit costs, the charge for a truncated row
# that stays, and the grammar (s?(ua)+)? over role initials.
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
LEGAL = ("su", "ua", "au")
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where a kept initial
# leads, and where a user or assistant turn (inserted or reroled) leads.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (2, 2, 3, 2)
MADE_ROLE = ("user", "user", "assistant", "user")
# At the end: what closes the grammar from each state.
END_COSTS, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
MUST_DELETE = "x"
FRAME_ROWS = 20_000

SLICE = ("kind string, conv string, part long, pos long, role string, digest binary, sig string, blank long, duplicate long, "
         "truncated long, illegal long, first_initial string, last_initial string, min_turn long, max_turn long, turns long")
AUDIT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Automaton:
    """Cost tables of endings. ``tables[t]`` are the costs from each grammar
    state, less their minimum; ``step(t, symbol)`` prepends a turn and gives
    ``(table, constant, moves)``, ``moves[state] = (edits, next state)``."""

    def __init__(self):
        self.tables = [END_COSTS]
        self.number = {END_COSTS: 0}
        self.steps = {}

    def step(self, table: int, symbol: str):
        found = self.steps.get((table, symbol))
        if found is None:
            found = self.steps[table, symbol] = self._make(self.tables[table], symbol)
        return found

    def _make(self, after, symbol):
        row = []  # cheapest edit of the turn itself per state: (cost, letter, next state)
        charge = TRUNCATED if symbol.isupper() else 0
        for state in range(4):
            options = [(DELETE + after[state], "D", state)]
            if symbol != MUST_DELETE:
                options.append((REROLE + charge + after[MADE[state]], "R", MADE[state]))
                kept = KEPT[state].get(symbol.lower())
                if kept is not None:
                    options.append((KEEP + charge + after[kept], "K", kept))
            row.append(min(options))
        # an insertion goes before the turn; two in a row from 2 or 3 only lead back
        cost = [r[0] for r in row]
        cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
        cost[0], cost[1] = min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2])
        moves = [None] * 4
        for state in (2, 3, 0, 1):
            edits, at = "", state
            while (INSERT + cost[MADE[at]], "I") < (row[at][0], row[at][1]):
                edits, at = edits + "I", MADE[at]
            moves[state] = (edits + row[at][1], row[at][2])
        least = min(cost)
        costs = tuple(c - least for c in cost)
        if costs not in self.number:
            self.number[costs] = len(self.tables)
            self.tables.append(costs)
        return self.number[costs], least, tuple(moves)


class Endings:
    """The nodes on the path of the current signature, from its end. Visiting
    signatures ordered by their reversed form visits every node once."""

    def __init__(self):
        self.automaton = Automaton()
        self.path, self.table, self.base, self.moves = "", [0], [0], []

    def visit(self, reverse: str) -> None:
        n = min(len(reverse), len(self.path))
        if reverse[:n] == self.path[:n]:
            shared = n
        else:  # binary search for the common beginning
            shared, high = 0, n
            while high - shared > 1:
                mid = (shared + high) // 2
                if reverse[shared:mid] == self.path[shared:mid]:
                    shared = mid
                else:
                    high = mid
        del self.table[shared + 1:], self.base[shared + 1:], self.moves[shared:]
        for symbol in reverse[shared:]:
            table, least, moves = self.automaton.step(self.table[-1], symbol)
            self.table.append(table)
            self.base.append(self.base[-1] + least)
            self.moves.append(moves)
        self.path = reverse

    def result(self) -> tuple[int, str]:
        """``(cost, audit)`` of the current signature."""
        state, edits = 0, []
        for moves in reversed(self.moves):
            chunk, state = moves[state]
            edits.append(chunk)
        edits.append(END_EDITS[state])
        return self.base[-1] + self.automaton.tables[self.table[-1]][0], "".join(edits)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, digest`` with NULL role and text as one
    space; the id travels as a string."""
    space = F.lit(" ")
    t = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
    return t.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


ORDER = ["conv", "turn", "role", "digest"]  # ascending, NULLs first


class _Slice:
    """The turns of one conversation in one partition."""

    def __init__(self, conv):
        self.conv, self.sig, self.seen = conv, [], {}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role, digest, fault):
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            turn = int(turn)
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.high, self.turns = turn, self.turns + 1
        if fault == "blank":
            self.blank += 1
            self.sig.append(MUST_DELETE)
            return
        if self.seen.setdefault((role, digest), len(self.sig)) != len(self.sig):
            self.duplicate += 1
            self.sig.append(MUST_DELETE)
            return
        symbol = initial if initial in ("s", "u", "a") else "o"
        if fault == "truncated":
            self.truncated += 1
            symbol = symbol.upper()
        self.sig.append(symbol)

    def rows(self, part: int, edge: bool):
        yield ("slice", self.conv, part, None, None, None, "".join(self.sig), self.blank, self.duplicate, self.truncated,
               self.illegal, self.first, self.last, self.low, self.high, self.turns)
        if edge:  # the conversation may go on in another partition
            for (role, digest), pos in self.seen.items():
                yield ("key", self.conv, part, pos, role, digest) + (None,) * 10


def _frame(rows, schema) -> pd.DataFrame:
    """Rows as a frame; longs as nullable integers, never as floats."""
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pd.DataFrame({name: pd.array(list(v), dtype="Int64") if kind == "long" else pd.Series(list(v), dtype="object")
                         for (name, kind), v in zip(fields, columns)})


def _slices(batches):
    part, current, first, rows = TaskContext.get().partitionId(), None, True, []
    for frame in batches:
        for conv, turn, role, digest, fault in zip(*(frame[c] for c in ("conv", "turn", "role", "digest", "fault"))):
            if current is None or conv != current.conv:
                if current is not None:
                    rows.extend(current.rows(part, first))
                    first = False
                current = _Slice(conv)
            current.add(turn, role, digest, fault)
            if len(rows) >= FRAME_ROWS:
                yield _frame(rows, SLICE)
                rows = []
    if current is not None:
        rows.extend(current.rows(part, True))
    for at in range(0, len(rows), FRAME_ROWS):
        yield _frame(rows[at:at + FRAME_ROWS], SLICE)


def _patch(batches):
    """Turn the symbols at ``at`` into duplicates."""
    for frame in batches:
        sigs, dup, cut = [], [], []
        for sig, at in zip(frame["sig"], frame["at"]):
            chars = list(sig)
            cut.append(sum(chars[i].isupper() for i in at))
            for i in at:
                chars[i] = MUST_DELETE
            sigs.append("".join(chars))
            dup.append(len(at))
        yield frame.assign(sig=sigs, duplicate=frame["duplicate"] + dup, truncated=frame["truncated"] - cut).drop(columns="at")


def signatures(turns: DataFrame) -> DataFrame:
    """Per conversation: ``conv, sig`` (a symbol per turn), its fault counts,
    ``illegal`` and ``gaps``."""
    ship_package(turns.sparkSession)
    end = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    fault = F.when(end == "", "blank").when(F.substring(end, -1, 1).isin(".", "!", "?"), "none").otherwise("truncated")
    narrow = turns.select("conv", "turn", "role", "digest", fault.alias("fault"))
    ordered = narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    # turns travel as text: a NULL must not turn the column into floats
    told = materialize(ordered.select("conv", F.col("turn").cast("string").alias("turn"), "role", "digest", "fault")
                       .mapInPandas(_slices, SLICE))
    slices = told.filter("kind = 'slice'").drop("kind", "pos", "role", "digest")
    # first occurrences in several slices of one conversation: all but the first slice's are duplicates
    again = (told.filter("kind = 'key'").groupBy("conv", "role", "digest")
             .agg(F.array_sort(F.collect_list(F.struct("part", "pos"))).alias("seen")).filter(F.size("seen") > 1)
             .select("conv", F.explode(F.expr("slice(seen, 2, size(seen) - 1)")).alias("s"))
             .groupBy(F.col("conv").alias("a_conv"), F.col("s.part").alias("a_part")).agg(F.collect_list("s.pos").alias("at")))
    joined = slices.join(again, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("part") == F.col("a_part")), "left") \
        .drop("a_conv", "a_part")
    joined = materialize(joined)
    whole = joined.filter("at IS NULL").drop("at")
    patched = joined.filter("at IS NOT NULL").mapInPandas(_patch, whole.schema)
    cols = ["part", "sig", "first_initial", "last_initial", "min_turn", "max_turn"]
    conv = whole.unionByName(patched).groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
        F.min("min_turn").alias("low"), F.max("max_turn").alias("high"),
        F.array_sort(F.collect_list(F.struct(*cols))).alias("s"))
    border = F.expr("zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (x, y) -> struct("
                    "if(concat(x.last_initial, y.first_initial) IN ('su', 'ua', 'au'), 0L, 1L) AS illegal, "
                    "if(coalesce(x.max_turn = y.min_turn, false), 1L, 0L) AS same))")
    conv = conv.withColumn("border", border)

    def total(name):
        return F.aggregate(F.transform("border", lambda x: x[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(
        F.col("high") - F.col("low") + 1 - (F.col("turns") - total("same")))
    return conv.select("conv", F.array_join(F.transform("s", lambda x: x["sig"]), "").alias("sig"), gaps.cast("long").alias("gaps"),
                       "blank", "duplicate", "truncated", (F.col("illegal") + total("illegal")).alias("illegal"))


def _audits(batches):
    endings, last, result = Endings(), None, None
    for frame in batches:
        costs, audits = [], []
        for reverse in frame["rev"]:
            if reverse != last:
                endings.visit(reverse)
                last, result = reverse, endings.result()
            costs.append(result[0])
            audits.append(result[1])
        yield frame.drop(columns="rev").assign(cost=costs, audit=audits)


def audits(signed: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` from
    ``signatures``."""
    ship_package(signed.sparkSession)
    by_end = signed.withColumn("rev", F.reverse("sig")).drop("sig")
    return by_end.repartitionByRange("rev", "conv").sortWithinPartitions("rev", "conv").mapInPandas(_audits, AUDIT)


class _Replay:
    """Applies an audit to the turns of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            role, self.state, self.at = MADE_ROLE[self.state], MADE[self.state], self.at + 1
            yield "I", role, ""

    def turn(self, role, text):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        if edit == "R":
            role, self.state = MADE_ROLE[self.state], MADE[self.state]
        else:
            self.state = KEPT[self.state][role[:1]]
        yield edit, role, text


def _replayed(batches):
    """``(conversation row, edit, role, text)`` in order; the first of each
    conversation has no edit."""
    current, replay = None, None
    for frame in batches:
        for row in frame.itertuples(index=False):
            if row.tag < 2:  # 0: the id alone, 1: the audit
                if current is None or row.conv != current.conv or row.tag == 0:
                    if replay is not None:
                        yield from ((current, *t) for t in replay.inserted())
                    yield row, None, None, None
                elif row.tag == 1:  # follows the id's row
                    yield row, None, None, None
                current, replay = row, _Replay(row.audit if row.tag == 1 else "")
                continue
            yield from ((current, *t) for t in replay.turn(row.role, row.text))
    if replay is not None:
        yield from ((current, *t) for t in replay.inserted())


def _hashed(batches):
    """One row per conversation: the audit's columns and the SHA-256 of the
    repaired ``role:text`` lines."""
    rows, current, digest, lines = [], None, None, 0
    for row, edit, role, text in _replayed(batches):
        if edit is None:
            if current is not None and current.conv == row.conv and current.tag == 0 and row.tag == 1:
                current = row
                continue
            if current is not None:
                rows.append(_finished(current, digest))
            current, digest, lines = row, hashlib.sha256(), 0
            if len(rows) >= FRAME_ROWS:
                yield _frame(rows, HASHED)
                rows = []
            continue
        digest.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        lines += 1
    if current is not None:
        rows.append(_finished(current, digest))
    if rows:
        yield _frame(rows, HASHED)


HASHED = AUDIT + ", repaired_sha256 string"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _finished(row, digest):
    counts = [int(getattr(row, c)) if row.tag == 1 else 0 for c in NUMBERS]
    return (row.conv, *counts, row.audit if row.tag == 1 else "", digest.hexdigest())


def _turns_made(batches):
    rows, current, n = [], None, 0
    for row, edit, role, text in _replayed(batches):
        if edit is None:
            if current is None or current != (row.conv,):
                current, n = (row.conv,), 0
            continue
        rows.append((row.conv, n, role, text, edit))
        n += 1
        if len(rows) >= FRAME_ROWS:
            yield _frame(rows, REPAIRED)
            rows = []
    if rows:
        yield _frame(rows, REPAIRED)


REPAIRED = "conv string, position long, role string, text string, edit string"


def _beside_their_audits(turns: DataFrame, audited: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Ids, audits and turns of a conversation behind each other in a task."""
    def missing(kind, *names):
        return [F.lit(None).cast(kind).alias(n) for n in names]
    head = audited.select("conv", F.lit(1).alias("tag"), *[F.col(c).cast("int").cast("long").alias(c) for c in NUMBERS], "audit",
                          *missing("long", "turn"), *missing("string", "role", "text"), *missing("binary", "digest"))
    body = turns.select("conv", F.lit(2).alias("tag"), *missing("long", *NUMBERS), *missing("string", "audit"),
                        "turn", "role", "text", "digest")
    parts = [head, body]
    if ids is not None:
        parts.append(ids.select(F.col("conv_id").cast("string").alias("conv"), F.lit(0).alias("tag"), *missing("long", *NUMBERS),
                                *missing("string", "audit"), *missing("long", "turn"), *missing("string", "role", "text"),
                                *missing("binary", "digest")).distinct())
    rows = reduce(DataFrame.unionByName, parts).repartition("conv")
    return rows.sortWithinPartitions("conv", "tag", "turn", "role", "digest").drop("turn", "digest")


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` per conversation of ``conversations`` (``conv_id, turn,
    role, text``; other columns are ignored). ``ids`` (``conv_id``) adds
    conversations that have no turn: zeros, an empty audit, the hash of
    nothing.

    A turn's first fault counts: blank (no visible character), duplicate (role
    and text seen earlier), truncated (does not end in ``.!?``). Turns are
    ordered by turn (NULLs first), then role and text digest, so the
    result does not depend on the input's order. NULL role and text are one
    space; rows without a conversation id are one conversation. ``gaps`` ignores
    NULL turns. Edits that tie in cost give the smallest audit. Repeated rows
    are duplicates. An empty table gives no rows."""
    turns = turn_rows(conversations)
    audited = materialize(audits(signatures(turns)))
    out = _beside_their_audits(turns, audited, ids).mapInPandas(_hashed, HASHED)
    return out.select(F.col("conv").cast("long").alias("conv_id"), *NUMBERS[:5], "cost", "audit", "repaired_sha256")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations, ``conv_id, position, role, text, edit``
    (``K`` kept, ``R`` new role, ``I`` inserted); rules as above. A
    conversation of which nothing is kept has no rows."""
    turns = turn_rows(conversations)
    audited = materialize(audits(signatures(turns)))
    out = _beside_their_audits(turns, audited, None).mapInPandas(_turns_made, REPAIRED)
    return out.select(F.col("conv").cast("long").alias("conv_id"), "position", "role", "text", "edit")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(``conv_id:turn``) % 20: 0 drops a row,
    1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it a user
    turn; a NULL is one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    c = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("c"))
    c = c.filter("c <> 0").select(
        "conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("c") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return c.drop("copy")
