"""Directory trees: names are listed level by level, contents read for chosen files only.

Spark's own listing hides names that begin with ``_``, which code trees are full of. A root is a
path or a URI of a file system that every executor reaches.

Files of any size can be read as chunks of whole lines (``read_chunks``): a chunk begins with the first
line that starts in its range of bytes and ends with the last one, wherever that ends, so no task
holds more than a range and a line, and the tasks of one file need not know of each other.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.session import cut, importable

_ENTRY = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("n_bytes", pa.int64())])
_CONTENT = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("content", pa.binary())])
_ENTRIES_A_BATCH = 10_000
_BYTES_A_BATCH = 32 << 20
#: Contents that a reading task gets on average.
BYTES_A_TASK = 128 << 20
#: Bytes of a file that one task reads at a time, as lines.
CHUNK_BYTES = 64 << 20
#: How far a task looks for the end of its last line at a time.
_STEP = 1 << 20
#: A value of Spark holds less than 2 GiB; larger files are read as chunks.
READABLE_BYTES = (1 << 31) - (1 << 20)


def resolved(root: str) -> str:
    """``root`` as it is for a URI, else as an absolute path."""
    return root if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) else os.path.abspath(root)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if os.path.isabs(root):
        return fs.LocalFileSystem(), root.rstrip("/")
    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _entries(system: fs.FileSystem, base: str, directory: str) -> Iterator[tuple[str, bool, int | None]]:
    """Files and directories right below; links to directories are not followed.

    A directory that may not be read is an entry itself, without a size."""
    if isinstance(system, fs.LocalFileSystem):
        yield from _local_entries(base, directory)
        return
    try:
        found = system.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/") or "/"))
    except (PermissionError, FileNotFoundError):
        yield directory, False, None
        return
    for info in found:
        is_dir = info.type == fs.FileType.Directory
        if is_dir or info.type == fs.FileType.File:
            yield f"{directory}/{info.base_name}".lstrip("/"), is_dir, None if is_dir else info.size


def _local_entries(base: str, directory: str) -> Iterator[tuple[str, bool, int | None]]:
    """As ``_entries``, name by name: a directory of any number of names is never held."""
    try:
        with os.scandir(f"{base}/{directory}".rstrip("/") or "/") as found:
            for entry in found:
                try:
                    mode = entry.stat()
                except FileNotFoundError:  # gone, or a link to nothing
                    continue
                is_dir = stat.S_ISDIR(mode.st_mode)
                if is_dir and entry.is_symlink():
                    continue
                if is_dir or stat.S_ISREG(mode.st_mode):
                    yield f"{directory}/{entry.name}".lstrip("/"), is_dir, None if is_dir else mode.st_size
    except (PermissionError, FileNotFoundError):
        yield directory, False, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def _list(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        rows: list[tuple] = []
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                for entry in _entries(system, base, directory):
                    rows.append(entry)
                    if len(rows) == _ENTRIES_A_BATCH:
                        yield _batch(rows, _ENTRY)
                        rows = []
        if rows:
            yield _batch(rows, _ENTRY)
    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        content = stream.read()
                except (PermissionError, FileNotFoundError, IsADirectoryError):
                    continue
                if rows and held + len(content) > _BYTES_A_BATCH:
                    yield _batch(rows, _CONTENT)
                    rows, held = [], 0
                rows.append((path, len(content), content))
                held += len(content)
        if rows:
            yield _batch(rows, _CONTENT)
    return run


def list_entries(spark: SparkSession, root: str, closed) -> DataFrame:
    """``(path, n_bytes)`` of all files below ``root``, paths relative to it.

    Directories for whose path (with a ``/`` behind) ``closed`` gives true are not opened; those
    that cannot be are listed without a size. A job lists a level, a task a share of its directories.
    """
    root = resolved(root)
    importable(spark)
    system, base = _opened(root)
    if system.get_file_info(base or "/").type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        listed = cut(level.repartition(tasks, "path").mapInArrow(_list(root), "path string, is_dir boolean, n_bytes long"))
        levels.append(listed.filter(~F.col("is_dir")).select("path", "n_bytes"))
        level = listed.filter(F.col("is_dir") & ~closed(F.concat("path", F.lit("/")))).select("path")
    return reduce(DataFrame.unionAll, levels)


def list_files(spark: SparkSession, root: str, closed) -> DataFrame:
    """The ``list_entries`` that are files."""
    return list_entries(spark, root, closed).filter(F.col("n_bytes").isNotNull())


def unreadable(listed: DataFrame, root: str) -> DataFrame:
    """``(path, n_bytes)`` of the listed files that cannot be opened (or are gone)."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(resolved_root)
        for batch in batches:
            closed = []
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        stream.read(1)
                    closed.append(False)
                except OSError:
                    closed.append(True)
            yield batch.filter(pa.array(closed, pa.bool_()))

    resolved_root = resolved(root)
    importable(listed.sparkSession)
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path", "n_bytes").repartition(tasks, "path").mapInArrow(probe, "path string, n_bytes long")


def write_files(files: DataFrame, root: str) -> None:
    """Write the contents of ``files(path, content)`` as a tree below ``root``, each task its own."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(resolved_root)
        made: set[str] = set()
        for batch in batches:
            for path_, content in zip(batch.column(0), batch.column(1), strict=True):
                path = f"{base}/{path_.as_py()}"
                if (parent := os.path.dirname(path)) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(path) as stream:
                    stream.write(content.as_buffer())  # no second copy of a batch of contents
            yield batch.slice(0, 0).select([0])

    resolved_root = resolved(root)
    importable(files.sparkSession)
    files.select("path", F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("content")).mapInArrow(
        write, "path string").count()


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """``(path, n_bytes, content)`` of the listed files, contents as bytes.

    Files that may not be read or are gone are left out, as are those no value can hold."""
    spark = listed.sparkSession
    importable(spark)
    readable = listed.filter(F.col("n_bytes") <= READABLE_BYTES).select("path", "n_bytes")
    total = readable.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_A_TASK))
    return readable.repartition(tasks, "path").mapInArrow(
        _read(resolved(root)), "path string, n_bytes long, content binary")


def lines_of_chunk(source, size: int, first: int, end: int) -> bytes | None:
    """The lines that start at bytes ``first`` to ``end - 1`` of a file, joined as they stand; None without one.

    A line starts at 0 and behind every line feed, so one may start at the very end of the file."""
    last = end >= size  # the end of the file counts as a start
    source.seek(max(0, first - 1))
    data = source.read(min(end, size) - max(0, first - 1))
    begin = 0
    if first > 0:
        begin = data.find(b"\n") + 1
        if not begin:
            return None
    if last:
        return data[begin:]
    cut_ = data.endswith(b"\n")
    if begin == len(data) and cut_:
        return None  # the next line starts in the next range
    if cut_:
        return data[begin:-1]
    parts = [data[begin:]]
    while more := source.read(_STEP):
        stop = more.find(b"\n")
        parts.append(more if stop < 0 else more[:stop])
        if stop >= 0:
            break
    return b"".join(parts)


def _over_chunks(root: str, chunk_bytes: int, kept: int, make, schema: pa.Schema):
    """Rows of (path, n_bytes, chunk, ...) with what ``make`` gives for the lines of the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, n_bytes, chunk = row[:3]
                try:
                    with system.open_input_file(f"{base}/{path}") as source:
                        lines = lines_of_chunk(source, n_bytes, chunk * chunk_bytes, (chunk + 1) * chunk_bytes)
                except OSError:
                    continue
                if lines is None:
                    continue
                made = make(lines)
                size = len(made) if isinstance(made, bytes) else 8
                if rows and (held + size > _BYTES_A_BATCH or len(rows) == _ENTRIES_A_BATCH):
                    yield _batch(rows, schema)
                    rows, held = [], 0
                rows.append((*row[:kept], made))
                held += size
        if rows:
            yield _batch(rows, schema)
    return run


def read_chunks(listed: DataFrame, root: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(path, n_bytes, chunk, first_line, n_lines, content)`` of the listed files of any size.

    ``content`` holds whole lines, the first of which is line number ``first_line``; ``n_lines`` are those of
    the file. The chunks are read twice, once to count their lines, and never moved."""
    spark, root = listed.sparkSession, resolved(root)
    importable(spark)
    n = F.greatest(F.ceil(F.col("n_bytes") / chunk_bytes), F.lit(1)).cast("int")
    chunks = listed.select("path", "n_bytes", F.explode_outer(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [("path", pa.string()), ("n_bytes", pa.int64()), ("chunk", pa.int32())]
    counted = cut(chunks.repartition(tasks, "path", "chunk").mapInArrow(
        _over_chunks(root, chunk_bytes, 3, lambda x: x.count(b"\n") + 1, pa.schema([*key, ("n", pa.int64())])),
        "path string, n_bytes long, chunk int, n long"))
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        "path", "n_bytes", "chunk", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1).alias("first_line"),
        F.sum("n").over(whole).alias("n_lines"))
    numbers = [*key, ("first_line", pa.int64()), ("n_lines", pa.int64())]
    return placed.repartition(tasks, "path", "chunk").mapInArrow(
        _over_chunks(root, chunk_bytes, 5, lambda x: x, pa.schema([*numbers, ("content", pa.binary())])),
        "path string, n_bytes long, chunk int, first_line long, n_lines long, content binary")
