"""Persisted index and graph.

Plain Parquet has no MERGE and Spark cannot overwrite a path it is reading,
so a store is a set of immutable parts ``root/part=<id>`` and one small
commit file per change, ``root/_commits/<number>.json``. A part is written
completely under a name of its own before its commit file is created, and a
commit file is created only if its number is free: of several writers one
gets the number and the others take the next, so no part is lost, replaced or
seen half written. A part that was never committed is not read.

Any part holds all rows of the keys it changes, and a key is read from the
newest part that has it, so a batch writes its own keys only. A full part
replaces the commits it was made from (``compact_index``: those that it
read; ``write_index``: all before it); later ones stay on top of it, also
those committed while it was written.

A commit keeps the key range of its part as a fixed-size bit table of hashed
keys (``KEY_BITS``). A reader that asks for certain keys makes the same table of
these and opens only parts whose tables meet. A missing index reads as empty,
as in the reference.
"""

from __future__ import annotations

import base64
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tessera.operators.indexing import pack_index
from tessera.session import shuffles_dropped

INDEX_SCHEMA = "key string, chunk_no int, chunks int, summary string"
HASH_SCHEMA = INDEX_SCHEMA + ", text_hash string"
PACKED_SCHEMA = "map<string, struct<chunks:int, summaries:array<string>>>"
COMMIT_SCHEMA = "number long, part string, batch long, stream string, full boolean, replaces long, keys string"
GRAPH_SCHEMA = ("nodes array<struct<id:string,label:string>>, "
                "edges array<struct<`from`:string,`to`:string,type:string>>")
KEY_BITS = 1 << 16  # bits of a part's key table, whatever the part's size


@dataclass
class Commit:
    number: int
    part: str
    batch: int
    stream: str
    full: bool
    replaces: int
    keys: str

    @property
    def place(self) -> int:
        """Order of parts by content: a full part stands right after the last
        commit that it replaces."""
        return 2 * self.replaces + 1 if self.full else 2 * self.number


# ------------------------------------------------------------------ files

def _path(spark: SparkSession, path: str):
    """Hadoop file system and path of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless ``source`` is gone or ``target`` is there."""
    fs, s = _path(spark, source)
    _, t = _path(spark, target)
    return bool(fs.exists(s)) and not fs.exists(t) and bool(fs.rename(s, t))


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, at once and only if it does not exist;
    ``False`` if it does. The text is written beside it first. Local folders
    link it to its name, others rename it, which must not replace a file (HDFS
    and stores with its semantics)."""
    folder, name = path.rsplit("/", 1)
    fs, draft = _path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    _, target = _path(spark, path)
    if fs.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), fs.makeQualified(target).toUri().getPath())
            made = True
        except FileExistsError:
            made = False
    else:
        made = not fs.exists(target) and bool(fs.rename(draft, target))
    if fs.exists(draft):
        fs.delete(draft, False)
    return made


# ------------------------------------------------------------------ commits

def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits in order: one small row per change of the store."""
    fs, folder = _path(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return []
    try:
        rows = spark.read.schema(COMMIT_SCHEMA).json(f"{root}/_commits").collect()
    except AnalysisException:
        return []
    return sorted((Commit(**r.asDict()) for r in rows), key=lambda c: c.number)


def _live(found: list[Commit]) -> list[Commit]:
    full = [c for c in found if c.full]
    if not full:
        return found
    base = full[-1]
    return sorted([base] + [c for c in found if not c.full and c.number > base.replaces], key=lambda c: c.place)


def latest_snapshot(spark: SparkSession, root: str) -> tuple[int, int] | None:
    """``(number, batch)`` of the newest commit."""
    found = commits(spark, root)
    return (found[-1].number, found[-1].batch) if found else None


def live_parts(spark: SparkSession, root: str) -> list[int]:
    """Commit numbers of the parts that make up the content."""
    return [c.number for c in _live(commits(spark, root))]


def key_table(df: DataFrame, keys: list[str]) -> bytes:
    """Bit table of the hashed keys: at most ``KEY_BITS / 64`` numbers reach
    the driver, however many rows there are."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(KEY_BITS))
    rows = (df.select(F.shiftright(bit, 6).cast("int").alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
            .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect())
    table = bytearray(KEY_BITS // 8)
    for r in rows:
        table[8 * r["w"]:8 * r["w"] + 8] = (r["v"] & (2 ** 64 - 1)).to_bytes(8, "little")
    return bytes(table)


def _may_hold(commit: Commit, table: bytes) -> bool:
    return bool(int.from_bytes(base64.b64decode(commit.keys), "little") & int.from_bytes(table, "little"))


def commit_part(df: DataFrame, root: str, fmt: str, keys: list[str], full: bool = False, replaces: int | None = None,
                batch: int | None = None, stream: str = "") -> int:
    """Write ``df`` as a part and commit it; returns the commit's number. A
    batch that the same ``stream`` has committed is not committed again
    (idempotent replays of a micro-batch); a stream with a new checkpoint
    counts from 0 again under another id. ``replaces`` is the last commit that a
    full part was made from (default: all before it)."""
    spark = df.sparkSession

    def done(found):
        return next((c.number for c in found if batch is not None and (c.batch, c.stream) == (batch, stream)), None)
    before = done(commits(spark, root))
    if before is not None:
        return before
    part = uuid.uuid4().hex
    path = f"{root}/part={part}"
    with shuffles_dropped(spark):
        df.write.format(fmt).save(path)
    table = base64.b64encode(key_table(spark.read.schema(df.schema).format(fmt).load(path), keys)).decode()
    make_folder(spark, f"{root}/_commits")
    while True:  # each round that fails is a commit of another writer
        found = commits(spark, root)
        before = done(found)
        if before is not None:
            return before
        n = found[-1].number + 1 if found else 1
        row = spark.createDataFrame(
            [(n, part, -1 if batch is None else batch, stream, full, n - 1 if replaces is None else replaces, table)], COMMIT_SCHEMA)
        if create_new(spark, f"{root}/_commits/{n:020d}.json", row.toJSON().first() + "\n"):
            return n


def read_parts(spark: SparkSession, root: str, fmt: str, schema: str, keys: list[str],
               wanted: DataFrame | None = None) -> DataFrame | None:
    """Every key's rows from the newest part that has the key; ``None`` when
    nothing is stored. With ``wanted`` (the key columns) only these keys, and
    only parts that may hold one of them are opened. Only the key columns are
    read to find the newest part, and a single part needs no join."""
    live = _live(commits(spark, root))
    if not live:
        return None
    if wanted is not None:
        table = key_table(wanted, keys)
        live = [c for c in live if _may_hold(c, table)]
        if not live:
            return spark.createDataFrame([], schema)
    rows = (spark.read.format(fmt).schema(f"{schema}, part string").option("basePath", root)
            .load([f"{root}/part={c.part}" for c in live]))

    def same(other, prefix):
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(other[f"{prefix}{k}"])
        return on
    if wanted is not None:
        asked = wanted.select(*[F.col(k).alias(f"__w_{k}") for k in keys]).distinct()
        rows = rows.join(asked, same(asked, "__w_"), "left_semi")
    if len(live) > 1:
        place = spark.createDataFrame([(c.part, c.place) for c in live], "part string, __place long")
        rows = rows.join(place, "part")
        newest = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("__place").alias("__newest"))
        rows = rows.join(newest, (F.col("__place") == F.col("__newest")) & same(newest, "__"), "left_semi")
    return rows.select(*StructType.fromDDL(schema).names)


def _stored(index: DataFrame) -> DataFrame:
    text_hash = "text_hash" if "text_hash" in index.columns else F.lit(None).cast("string").alias("text_hash")
    return index.select("key", "chunk_no", "chunks", "summary", text_hash)


def read_index(spark: SparkSession, root: str, hashes: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """Exploded index rows, or an empty index; with ``hashes`` also the
    ``text_hash`` that ``index_documents(by="hash")`` compares (NULL where the
    rows were written without). ``wanted`` (``key``) asks for these keys only."""
    schema = HASH_SCHEMA if hashes else INDEX_SCHEMA
    rows = read_parts(spark, root, "parquet", schema, ["key"], wanted)
    return spark.createDataFrame([], schema) if rows is None else rows


def write_index(index: DataFrame, root: str, batch: int | None = None, stream: str = "") -> int:
    """Write ``index`` as the whole new content; see ``commit_part``."""
    return commit_part(_stored(index), root, "parquet", ["key"], True, None, batch, stream)


def append_index(updates: DataFrame, root: str, batch: int | None = None, stream: str = "") -> int:
    """Write only ``updates``, which hold all rows of the keys in them (the
    D8 upsert, resolved on reading); see ``commit_part``."""
    return commit_part(_stored(updates), root, "parquet", ["key"], False, None, batch, stream)


def compact_index(spark: SparkSession, root: str) -> int:
    """Rewrite the live parts as one full part; parts committed meanwhile
    stay on top of it."""
    last = latest_snapshot(spark, root)
    return commit_part(_stored(read_index(spark, root, hashes=True)), root, "parquet", ["key"], True, last[0] if last else 0)


def export_index_json(index: DataFrame, path: str) -> None:
    """JSON lines, one ``{key: {chunks, summaries}}`` object per document
    (the reference keeps one JSON object for the whole index; one line per
    key keeps the export parallel)."""
    packed = pack_index(index)
    line = F.to_json(F.create_map(F.col("key"), F.struct("chunks", "summaries")))
    packed.select(line.alias("value")).write.mode("overwrite").text(path)


def import_index_json(spark: SparkSession, path: str) -> DataFrame:
    """Read index JSON into exploded rows: files of one object per line, or
    files that are one object for the whole index, indented or not;
    unparseable input gives no rows."""
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    files = files.select("value", lines.alias("lines"))
    # an object per line if the first line closes the object it opens
    by_line = F.coalesce(F.trim(F.try_element_at("lines", F.lit(1))).rlike("^[{].*[}]$"), F.lit(False))
    maps = F.when(by_line, F.transform("lines", lambda x: F.from_json(x, PACKED_SCHEMA))) \
        .otherwise(F.array(F.from_json("value", PACKED_SCHEMA)))
    raw = files.select(F.explode(maps).alias("m"))
    parsed = raw.filter(F.col("m").isNotNull()).select(F.explode("m").alias("key", "v"))
    return parsed.select("key", F.posexplode("v.summaries").alias("p", "summary"), F.col("v.chunks").alias("chunks")) \
        .select("key", (F.col("p") + 1).alias("chunk_no"), "chunks", "summary")


def read_graph(spark: SparkSession, root: str, keys_schema: str) -> DataFrame | None:
    """The newest saved graph of every key ``(keys..., nodes, edges)``, or
    ``None`` when nothing was saved yet (the reference's "no graph" state)."""
    return read_parts(spark, root, "json", f"{keys_schema}, {GRAPH_SCHEMA}", StructType.fromDDL(keys_schema).names)


def write_graph(graphs: DataFrame, root: str, keys: list[str], keys_schema: str,
                graph: str = "graph") -> int | None:
    """Save parsed graphs. Keys whose parse failed (NULL graph) keep
    their previously saved graph; keys with a new graph replace theirs, and
    only these are written. Nothing is written when no graph parsed."""
    new = graphs.filter(F.col(graph).isNotNull()).select(*keys, f"{graph}.nodes", f"{graph}.edges")
    if not new.limit(1).count():
        return None
    return commit_part(new, root, "json", keys)
