"""Roll-ups kept up to date while files are edited, moved and deleted.

A feed brings versions of files, ``(file_id, version, path, content, deleted)``, in any order and
repeated as it likes. Of a file the greatest version counts; among equal ones a deletion, then the
one that came first. Late versions are dropped by key, before their contents are derived or moved. Each
batch is compared with what is known of its own files only: what a file gave before is taken off the
roll-ups, what it gives now is added. Unchanged files are neither read nor analysed again. Rows without ``file_id`` or ``version`` are not part of a feed and are passed over.

Kept below one shared folder, a sub-folder a batch, written whole and never changed after:

* ``figures``: a row for each version that became current: its counts, or none if deleted or not analysable;
* ``issues``: the findings of these versions;
* ``corrections``: signed sums by directory, what the batch changes in the roll-up.

A batch that is run again reads the batches before it only and replaces its own folders, so a restart counts
nothing twice. ``corrections`` come last: a batch without them has not happened for a reader.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codestrata.operators import rollup
from codestrata.operators.findings import ISSUE_COLUMNS
from codestrata.plans.analysis import Analysis

CHANGES_SCHEMA = "file_id long, version long, path string, content string, deleted boolean"
COUNTS = ("line_count", "complexity", "issue_count", "security_issues", "quality_issues", "ai_issues")
SUMS = ("files", "line_count", "complexity", "issue_count", "security_issues")
FIGURES_SCHEMA = ("file_id long, version long, deleted boolean, present boolean, path string, "
                  + ", ".join(f"{c} long" for c in COUNTS) + ", batch long")
CORRECTIONS_SCHEMA = "directory string, " + ", ".join(f"{c} long" for c in SUMS) + ", batch long"


def newest_versions(changes: DataFrame) -> DataFrame:
    """A row per file: its greatest version, a deletion before others; equal ones by a hash of what they hold."""
    deleted = F.coalesce("deleted", F.lit(False))
    return (
        changes.filter("file_id IS NOT NULL AND version IS NOT NULL")
        .groupBy("file_id")
        .agg(F.max_by(F.struct("version", deleted.alias("deleted"), "path", "content"),
                      F.struct("version", deleted, F.xxhash64("path", "content"))).alias("x"))
        .select("file_id", "x.*")
    )


def newer_than(changes: DataFrame, known: DataFrame) -> DataFrame:
    """The changes that no version in ``known`` stands against.

    An anti join by key and version: Spark moves it below what derives the contents, so those of late versions never are."""
    known = known.select(
        F.col("file_id").alias("known_id"), F.col("version").alias("known_version"), F.col("deleted").alias("known_deleted"))
    version, deleted = F.col("version"), F.coalesce("deleted", F.lit(False))
    stands = (F.col("known_version") > version) | ((F.col("known_version") == version) & (F.col("known_deleted") >= deleted))
    return changes.join(known, (F.col("file_id") == F.col("known_id")) & stands, "left_anti")


@dataclass(frozen=True)
class Corrected:
    """The state of a feed below ``folder``, which all executors share."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str | None) -> DataFrame | None:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema) if schema else None

    def _write(self, table: DataFrame, name: str, batch_id: int) -> str:
        path = f"{self.folder}/{name}/batch={batch_id}"
        table.write.mode("overwrite").parquet(path)
        return path

    def _current(self, figures: DataFrame) -> DataFrame:
        """The counting version of each file, gone ones included."""
        names = [c for c in figures.columns if c not in ("file_id", "batch")]
        newest = F.max_by(F.struct(*names), F.struct("version", "deleted", -F.col("batch")))
        return figures.groupBy("file_id").agg(newest.alias("x")).select("file_id", "x.*")

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Take in one batch; batches come with rising numbers."""
        before = self._read("figures", FIGURES_SCHEMA).filter(F.col("batch") < batch_id).drop("batch").withColumn("batch", F.lit(0))
        # the contents are needed by the facts alone and once: on disk they leave the memory to the facts and their sorts
        fresh = newest_versions(newer_than(changes, before)).persist(StorageLevel.DISK_ONLY)
        keys = fresh.select("file_id", "version", "deleted", "path").persist(StorageLevel.MEMORY_AND_DISK)
        analysis = Analysis(fresh.filter("NOT deleted").select("file_id", "path", "content"))
        try:
            keys.count()  # one job stores both
            counts = analysis.file_counts.select("file_id", *(F.col(c).cast("long") for c in COUNTS), F.lit(True).alias("present"))
            figures = keys.join(counts, "file_id", "left").select(
                "file_id", "version", "deleted", F.coalesce("present", F.lit(False)).alias("present"), "path", *COUNTS)
            written = self._write(figures, "figures", batch_id)
            stored = self.spark.read.parquet(written)
            self._write(analysis.issues.join(stored.select("file_id", "version"), "file_id"), "issues", batch_id)
        finally:
            analysis.release()
            keys.unpersist()
            fresh.unpersist()
        # small tables from here on: figures of the batch's files, then and now
        then = self._current(before.join(stored.select("file_id"), "file_id", "left_semi"))
        sides = [
            rollup.directory_rollup(side.filter("present")).select("directory", *((sign * F.col(c)).alias(c) for c in SUMS))
            for side, sign in ((stored, 1), (then, -1))
        ]
        change = sides[0].unionByName(sides[1]).groupBy("directory").agg(*(F.sum(c).alias(c) for c in SUMS))
        self._write(change.filter(" OR ".join(f"{c} <> 0" for c in SUMS)), "corrections", batch_id)

    @property
    def files(self) -> DataFrame:
        """The current files with their counts."""
        return self._current(self._read("figures", FIGURES_SCHEMA)).filter("present").drop("deleted", "present")

    @property
    def issues(self) -> DataFrame:
        """The findings of the current versions."""
        stored = self._read("issues", None)
        if stored is None:
            stored = Analysis(self.spark.createDataFrame([], "file_id long, path string, content string"), keep=False).issues.withColumn("version", F.lit(0).cast("long"))
        return stored.join(self.files.select("file_id", "version"), ["file_id", "version"], "left_semi").select(*ISSUE_COLUMNS)

    @property
    def directories(self) -> DataFrame:
        """The roll-up of directories: the sum of all corrections; no file is looked at."""
        return (
            self._read("corrections", CORRECTIONS_SCHEMA).groupBy("directory")
            .agg(*(F.sum(c).alias(c) for c in SUMS)).filter("files <> 0")
        )

    @property
    def gate(self) -> DataFrame:
        top = self.directories.filter("directory = ''").select(
            F.col("files").alias("files_analyzed"), F.col("issue_count").alias("total_issues"), "security_issues")
        return rollup.gate(top.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in top.columns)))

    def compact(self, folder: str) -> Corrected:
        """The same state in another folder as one batch, numbered as the last one; go on from there."""
        last = self._read("corrections", CORRECTIONS_SCHEMA).agg(F.max("batch")).first()[0]
        other = Corrected(self.spark, folder)
        if last is not None:
            current = self._current(self._read("figures", FIGURES_SCHEMA))  # with the deleted: late versions must not revive them
            other._write(current, "figures", last)
            other._write(self.issues.join(current.filter("present").select("file_id", "version"), "file_id"), "issues", last)
            other._write(self.directories, "corrections", last)
        return other


def follow(changes: DataFrame, state: Corrected, checkpoint: str) -> DataStreamWriter:
    """Take a stream of versions into ``state``."""
    return changes.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint)
