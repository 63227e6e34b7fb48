"""Corpora of source files: a table ``files(file_id, path, content)``.

``file_id`` is a unique key of any type.  A table of several repositories names them as ``root``.  ``path`` is relative to the corpus root
and ``/`` separated.  A directory tree is read with :func:`scan_directory`; at scale the input is normally a Parquet table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import fixed_values as fv
from codestrata.operators.ranking import numbered
from codestrata.session import cut
from codestrata.sources import tree
from codestrata.sources.changes import roots
from codestrata.sources.lines import explode_chunks

#: Tasks of a heavy pass for every core, so that its last round is short.
TASKS_A_CORE = 4


def language_of(path: Column | str = "path") -> Column:
    """Language by the (case-sensitive) extension; NULL if it is not supported."""
    path = F.col(path) if isinstance(path, str) else path
    extension = F.regexp_extract(path, r"(\.[^./]*)\z", 1)
    pairs = [F.lit(x) for kv in fv.LANGUAGE_BY_EXTENSION.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension)


def is_pruned(path: Column | str = "path") -> Column:
    """Below an ignored directory, or any part of the path is hidden."""
    path = F.col(path) if isinstance(path, str) else path
    ignored = "|".join(d.replace(".", r"\.") for d in fv.IGNORED_DIRECTORIES)
    return path.rlike(rf"(?:^|/)(?:(?:{ignored})/|\.)")


def walk_key(path: Column | str = "path") -> Column:
    """Sorts as a recursive walk does: names compared level by level."""
    path = F.col(path) if isinstance(path, str) else path
    return F.split(path, "/", -1)


def estimated_lines(n_bytes: Column) -> Column:
    return F.floor(n_bytes / fv.ESTIMATED_BYTES_PER_LINE).cast("int")


_SCHEME_AND_SLASHES = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/+"


def relative_path(path: Column | str, root: str) -> Column:
    """``path`` relative to ``root``; unchanged if it lies elsewhere."""
    path = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(path, _SCHEME_AND_SLASHES, "")
    prefix = re.sub(_SCHEME_AND_SLASHES, "", root.rstrip("/")) + "/"
    return F.when(
        bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 2**31 - 1)
    ).otherwise(path)


def list_directory(spark: SparkSession, root: str) -> DataFrame:
    """``(file_id, path, n_bytes)`` of the files of a tree; nothing is opened.

    Ignored and hidden directories are not entered. What a name above the root is does not matter."""
    return tree.list_files(spark, root, is_pruned).select(F.col("path").alias("file_id"), "path", "n_bytes")


def _chosen(spark: SparkSession, root: str, max_bytes: int | None) -> DataFrame:
    return _chosen_of(list_directory(spark, root), max_bytes)


def _chosen_of(files: DataFrame, max_bytes: int | None) -> DataFrame:
    chosen = files.filter(language_of().isNotNull() & ~is_pruned())
    return chosen if max_bytes is None else chosen.filter(F.col("n_bytes") <= max_bytes)


def scan_directory_lines(
    spark: SparkSession, root: str, max_bytes: int | None = None, chunk_bytes: int = tree.CHUNK_BYTES
) -> DataFrame:
    """The lines of a directory tree, as ``lines.explode_lines`` gives them, of files of any size.

    A file is read as chunks of whole lines, so one of many GiB is the work of many tasks, and no
    task holds it. All operators of lines take these; those of whole contents take ``scan_directory``."""
    chunks = tree.read_chunks(_chosen(spark, root, max_bytes), root, chunk_bytes)
    content = F.make_valid_utf8(F.col("content").cast("string"))
    return explode_chunks(chunks.select(
        F.col("path").alias("file_id"), "path", language_of().alias("language"), F.col("n_lines").cast("int").alias("n_lines"),
        F.col("first_line").cast("int").alias("first_line"), content.alias("content")))


def skipped_in_directory(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """``(file_id, path, n_bytes, reason)`` of all below ``root`` that ``scan_directory`` does not give.

    Beside what ``skipped`` names these are the files and directories that cannot be opened (``unreadable``;
    the chosen files are opened to see), and files that no value can hold (``read as lines only``)."""
    entries = tree.list_entries(spark, root, is_pruned).select(F.col("path").alias("file_id"), "path", "n_bytes")
    files = entries.filter(F.col("n_bytes").isNotNull())
    chosen = _chosen_of(files, max_bytes)  # of the same list: the tree is walked once
    shut = cut(tree.unreadable(chosen, root))  # read twice below, the files are opened once
    no_value = chosen.filter(F.col("n_bytes") > tree.READABLE_BYTES)
    named = lambda t, reason: t.select(F.col("path").alias("file_id"), "path", "n_bytes", F.lit(reason).alias("reason"))
    return (
        skipped(files, max_bytes)
        .unionAll(named(entries.filter(F.col("n_bytes").isNull()), "unreadable"))
        .unionAll(named(shut, "unreadable"))
        .unionAll(named(no_value.join(shut, "path", "left_anti"), "read as lines only")))


def scan_directory(
    spark: SparkSession, root: str, max_bytes: int | None = None
) -> DataFrame:
    """Read a directory tree as ``files``, with the sizes as ``n_bytes``.

    The files are chosen by their paths and sizes first; no other is opened. A file that may not
    be read is left out. ``skipped_in_directory`` names all that is not in the result."""
    return tree.read_files(_chosen(spark, root, max_bytes), root).select(
        F.col("path").alias("file_id"), "path", "n_bytes",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def analysable(
    files: DataFrame,
    max_bytes: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The files that are analysed, with their ``language``.

    Without a limit files of any size are.  A table may bring its sizes as ``n_bytes``; a limit
    then reaches the scan, and contents of larger files are not read at all; ``skipped`` names them.
    """
    n_bytes = F.col("n_bytes") if "n_bytes" in files.columns else F.octet_length("content")
    kept = (
        files.withColumn("language", language_of())
        .filter(F.col("language").isNotNull())
        .filter(~is_pruned())
        .filter(F.lit(True) if max_bytes is None else n_bytes <= max_bytes)
        .select("file_id", *roots(files), "path", "language", "content")
    )
    return kept if max_files is None else first_in_walk_order(kept, max_files)


def skipped(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``(file_id, path, n_bytes, reason)`` of the files that ``analysable`` leaves out."""
    n_bytes = F.col("n_bytes") if "n_bytes" in files.columns else F.octet_length("content")
    too_large = F.lit(False) if max_bytes is None else F.col("n_bytes") > max_bytes
    reason = F.when(is_pruned(), "pruned").when(language_of().isNull(), "unsupported").when(too_large, "too large")
    return (
        files.withColumn("n_bytes", n_bytes)
        .select("file_id", "path", "n_bytes", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def unpruned(files: DataFrame) -> DataFrame:
    """All files a walk lists, supported or not."""
    return files.filter(~is_pruned())


def first_in_walk_order(files: DataFrame, max_files: int = fv.MAX_FILES) -> DataFrame:
    """The first ``max_files`` files of a recursive walk (of one root after the other).

    Only the paths are ranked, range by range; contents meet the chosen paths in a semi join.
    """
    key = [*roots(files), "path"]
    keys = files.select(*key, walk_key().alias("walk_key"))
    chosen = numbered(keys, [*roots(files), "walk_key"], "rank", max_files).select(*key)
    return files.join(chosen, key, "left_semi").select(files.columns)


def co_locate(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Bring each file to the partition of its ``file_id``.

    This is the one shuffle of the per-file windows and aggregates: it moves the
    compact contents before they are split into lines, and exploding keeps the
    partitioning.  The number of partitions is fixed: a megabyte of contents is seconds of work, so
    partitions that are merged by their bytes leave most cores idle in the last round.
    """
    return files.repartition(partitions or many_partitions(files.sparkSession), "file_id")


def many_partitions(spark: SparkSession) -> int:
    """As many as shuffles have, and some for every core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def save_bucketed(files: DataFrame, table: str, buckets: int) -> None:
    """Store a corpus so that later runs need no shuffle by ``file_id`` at all."""
    (
        files.repartition(buckets, "file_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "file_id")
        .sortBy("file_id")
        .saveAsTable(table)
    )
