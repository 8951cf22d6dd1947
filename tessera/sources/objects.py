"""Objects below a prefix, read with Spark's ``binaryFile`` source.

``read_objects`` lists and reads every file under ``root`` recursively; the
key is the path relative to ``root``. Because ``binaryFile`` only reads the
``content`` column when it is selected, a listing (``key``, ``length``) never
downloads the bytes, and an extension filter placed before the content is
used prunes the read (the reference downloads after its extension test too).

Spark's readers keep the status of every file on the driver. ``list_objects``
has tasks list the folders and gives the objects as rows instead, and
``read_contents`` and ``read_object_lines`` read them by these rows, so nothing on the driver
grows with their number. It needs a store that Python opens too; where there is
none, Spark's readers list.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from tessera.session import materialize, parts_of, ship_package, shuffles_dropped

BINARY_FILE_SCHEMA = StructType([
    StructField("path", StringType(), False),
    StructField("modificationTime", TimestampType(), False),
    StructField("length", LongType(), False),
    StructField("content", BinaryType(), True),
])


OBJECTS = "key string, length long, modified long"  # modified: milliseconds
PACKED = r"\.(gz|bz2|deflate|zst|snappy|lz4)$"       # names that Spark's text reader unpacks
BREAK = re.compile(rb"\r\n|\n|\r")
LISTED_ROWS = 10_000      # objects in a frame of a listing
READ_BYTES = 1 << 25      # bytes of contents or lines in a frame, at most about
TASK_OBJECTS = 20_000     # objects that a task reads, at most about


def relative_key(root: str):
    """Key of a file path relative to ``root``: a URI (``s3a://b/pre``,
    ``file:///x``), an absolute or a relative local path. Paths come back with
    their scheme, so a URI root is compared without empty authority."""
    r = root.rstrip("/") + "/"
    if "://" in r:
        scheme, rest = r.split("://", 1)
        r = f"{scheme}:{rest}" if rest.startswith("/") else r
    elif not r.startswith(f"{r.split(':', 1)[0]}:/"):
        r = os.path.abspath(root).rstrip("/") + "/"
    at = F.instr(F.col("path"), r)
    return F.substring(F.col("path"), at + len(r), F.length("path"))


def _glob_safe(text: str) -> str:
    """``text`` as a path pattern that matches itself only."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in text)


def _found_below(reader, root: str, prefix: str | None):
    """Load what lies below the prefix. The prefix is part of the listed path
    (``root/folder/name*``), so other folders are never listed; below it Spark
    lists sub-folders in tasks once there are more than
    ``spark.sql.sources.parallelPartitionDiscovery.threshold``. ``None`` if
    there is nothing.

    A whole folder is listed by tasks (``list_objects``); a prefix, a pattern and
    folders with packed objects by Spark's reader."""
    base = root.rstrip("/")
    if not prefix:
        wanted = [[base]]
    elif prefix.endswith("/"):
        # a prefix that is a folder is listed as one: a pattern would make every object in it a path of its own.
        # Folders in it whose names Spark takes as hidden are named beside it, if there are any.
        folder = f"{base}/{_glob_safe(prefix)}"
        wanted = [[folder, folder + "[_.]*"], [folder]]
    else:
        wanted = [[f"{base}/{_glob_safe(prefix)}*"]]
    for paths in wanted:
        try:
            return reader.load(paths)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


# Characters that a folder name has as %XX, as Spark's partitioned writers have it.
_ESCAPED = {chr(i) for i in range(1, 32)} | set("\"#%'*/:=?\\{[]^\x7f")


def folder_name(column: str, value) -> str:
    """``column=value`` as Spark's partitioned writers name the folder."""
    if value is None or value == "":
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in str(value))


def object_folder(spark: SparkSession, root: str) -> str | None:
    """``root`` as a qualified path, as Spark's readers name it, if it is a
    folder in a store that Python opens; else ``None``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path) or not store.getFileStatus(path).isDirectory():
        return None
    base = store.makeQualified(path).toString().rstrip("/")
    try:
        _store(base)
    except Exception:  # no such store in pyarrow, or its library is missing
        return None
    return base


def _store(base: str):
    """pyarrow's file system of a qualified path (``None``: local files) and
    the path in it."""
    if base.startswith("file:"):
        return None, "/" + base[5:].lstrip("/")
    from pyarrow import fs
    return fs.FileSystem.from_uri(base)


def _entries(store, folder: str):
    """``(name, is it a folder, size, milliseconds)`` of what is in a folder."""
    if store is None:
        with os.scandir(folder) as found:
            for e in found:
                at = e.stat()
                yield e.name, e.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000
        return
    from pyarrow import fs
    for e in store.get_file_info(fs.FileSelector(folder)):
        yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith(".") or name.endswith("._COPYING_") or
            name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata")))


def list_objects(spark: SparkSession, base: str) -> DataFrame:
    """``(key, length, modified)`` of every file below an ``object_folder``,
    ``key`` relative to it. Folders of one depth are listed by the tasks of one
    job, so there is a job per depth."""
    ship_package(spark)

    def run(batches):
        store, at = _store(base)
        for frame in batches:
            for folder in frame["key"]:
                rows = []
                for name, is_folder, size, ms in _entries(store, f"{at}/{folder}" if folder else at):
                    if not _hidden(name):
                        rows.append((f"{folder}/{name}" if folder else name, is_folder, size, ms))
                    if len(rows) >= LISTED_ROWS:
                        yield pd.DataFrame(rows, columns=["key", "folder", "length", "modified"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "folder", "length", "modified"])
    todo, out = spark.createDataFrame([("",)], "key string"), None
    while True:
        level = materialize(todo.mapInPandas(run, "key string, folder boolean, length long, modified long"))
        files = level.filter("NOT folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        folders = level.filter("folder").select("key")
        n = folders.count()
        if not n:
            return out
        todo = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def _open(store, path: str):
    return open(path, "rb") if store is None else store.open_input_file(path)


def read_contents(objects: DataFrame, base: str) -> DataFrame:
    """``(key, length, modified, content)`` of listed objects below ``base``;
    the rows say which task reads which object."""
    ship_package(objects.sparkSession)

    def run(batches):
        store, at = _store(base)
        rows, waiting = [], 0
        for frame in batches:
            for key, length, ms in zip(frame["key"], frame["length"], frame["modified"]):
                with _open(store, f"{at}/{key}") as f:
                    content = f.read()
                rows.append((key, len(content), ms, content))
                waiting += len(content)
                if waiting >= READ_BYTES or len(rows) >= LISTED_ROWS:
                    yield pd.DataFrame(rows, columns=["key", "length", "modified", "content"])
                    rows, waiting = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["key", "length", "modified", "content"])
    return objects.select("key", "length", "modified").mapInPandas(run, f"{OBJECTS}, content binary")


def range_lines(f, start: int, end: int, size: int) -> list[bytes]:
    """The lines of a file of ``size`` bytes that begin in the bytes ``start ..
    end - 1``, without their breaks (``\\n``, ``\\r\\n`` or ``\\r``) and
    without a byte order mark, as Spark's text reader has them."""
    f.seek(max(start - 1, 0))
    data = f.read(min(end, size) - max(start - 1, 0))
    if start == 0:
        data = data.removeprefix(b"\xef\xbb\xbf")
    else:
        first = BREAK.search(data)
        data = data[first.end():] if first else b""
    if not data:
        return []
    more = [data]
    while more[-1] and not BREAK.search(more[-1][-1:] if len(more) == 1 else more[-1]):
        more.append(f.read(1 << 20))
    if len(more) > 1:
        last = BREAK.search(more[-1])
        more[-1] = more[-1][:last.start()] if last else more[-1]
    return b"".join(more).splitlines()


def write_objects(df: DataFrame, root: str, folders: list[str], text: str = "text") -> None:
    """Write one text object per value of ``folders`` below ``root``:
    ``a=1/b=2.txt`` has the texts of its rows, each ended by a line break
    (NULL: an empty line). Objects have no folder of their own: a listing takes
    a step per folder.

    Rows are partitioned by their folders, so all tasks write and an object has
    one writer; a task creates its files itself. Nothing is renamed afterwards,
    file by file on the driver, as a partitioned table write does. A repeated
    task writes the same files again."""
    ship_package(df.sparkSession)

    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        at, out = None, None
        for frame in batches:
            for *names, line in zip(*(frame[c] for c in [*folders, "__line"])):
                *within, name = map(folder_name, folders, names)
                folder = "/".join([base.rstrip("/"), *within])
                if (folder, name) != at:
                    if out:
                        out.close()
                    if at is None or folder != at[0]:
                        store.create_dir(folder, recursive=True)
                    at, out = (folder, name), store.open_output_stream(f"{folder}/{name}.txt")
                out.write(line)
        if out:
            out.close()
        yield from ()
    named = df.select(*[F.col(c).cast("string").alias(c) for c in folders],
                      F.encode(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")), "UTF-8").alias("__line"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_dropped(df.sparkSession):
        (named.repartition(parts, *folders).sortWithinPartitions(*folders, "__line")
         .mapInPandas(run, "n long").write.format("noop").mode("overwrite").save())


def read_objects(spark: SparkSession, root: str, prefix: str | None = None,
                 glob: str | None = None) -> DataFrame:
    """``(key, length, modificationTime, content)`` for every file below
    ``root`` whose key starts with ``prefix``; no rows if the folder or the
    prefix does not exist. An object is one row, so it has to fit one
    (``spark.sql.sources.binaryFile.maxLength``); larger ones are read in ranges
    by ``read_object_lines``."""
    reader = spark.read.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = _found_below(reader, root, prefix)
    if df is None:
        return spark.createDataFrame([], "key string, length long, modificationTime timestamp, content binary")
    df = df.select(relative_key(root).alias("key"), "length", "modificationTime", "content")
    return df.filter(F.col("key").startswith(prefix)) if prefix else df


def read_object_lines(spark: SparkSession, root: str, prefix: str | None = None,
                      glob: str | None = None) -> DataFrame:
    """``(key, range, line_no, line)``: text objects of any size, read in byte
    ranges by many tasks (``spark.sql.files.maxPartitionBytes`` each). ``range`` is
    the first byte of the range a line was read with; ordered by ``(range,
    line_no)`` the lines of a key are those of the object. No rows if
    there is nothing.

    A whole folder is listed by tasks (``list_objects``); a prefix, a pattern and
    folders with packed objects by Spark's reader."""
    base = None if prefix or glob else object_folder(spark, root)
    if base is not None:
        found = _ranges(spark, base)
        if found is not None:
            return found
    reader = spark.read.format("text").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = _found_below(reader, root, prefix)
    if df is None:
        return spark.createDataFrame([], "key string, range long, line_no long, line string")
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
                   F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    # file_path is a URI with escapes, the reader's own path is not
    df = df.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    df = df.select(relative_key(root).alias("key"), "range", "line_no", "line")
    return df.filter(F.col("key").startswith(prefix)) if prefix else df


def _ranges(spark: SparkSession, base: str) -> DataFrame | None:
    """``read_object_lines`` of a whole folder; ``None`` if some objects have to
    be unpacked."""
    objects = list_objects(spark, base)
    size, number, packed = objects.agg(F.sum("length"), F.count(F.lit(1)), F.count_if(F.col("key").rlike(PACKED))).first()
    if packed:
        return None
    step = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    ranges = objects.filter("length > 0").select("key", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(step))).alias("range"))
    n = max(parts_of(spark, size, step), parts_of(spark, number, TASK_OBJECTS))

    def run(batches):
        store, at = _store(base)
        rows, waiting = [], 0
        for frame in batches:
            for key, length, start in zip(frame["key"], frame["length"], frame["range"]):
                with _open(store, f"{at}/{key}") as f:
                    lines = range_lines(f, start, start + step, length)
                for i, line in enumerate(lines):
                    rows.append((key, start, i, line))
                    waiting += len(line) + 1
                    if waiting >= READ_BYTES or len(rows) >= LISTED_ROWS:
                        yield pd.DataFrame(rows, columns=["key", "range", "line_no", "line"])
                        rows, waiting = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["key", "range", "line_no", "line"])
    return (ranges.repartition(n).mapInPandas(run, "key string, range long, line_no long, line binary")
            .withColumn("line", F.col("line").cast("string")))
