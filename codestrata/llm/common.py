"""What the operators share: tables, cuts of lineage, Arrow batches in bounded slices."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into arrays at a time (one longer text is taken whole).
SLICE_BYTES = 1 << 20


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On other machines ship it with the job (--py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share.

    Only where it names none and runs on one machine (tests), one of its own is made."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows written below the shared folder, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, bounds) of runs of rows of a string or binary column.

    Row first + i holds bytes[bounds[i]:bounds[i + 1]]; a null is an empty text. A run holds about
    `most` bytes, or one longer row."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    if column.null_count:  # bytes below a null are not part of any text
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        if not np.array_equal(lengths, np.diff(at)):
            yield from slices(column.fill_null(""), most)
            return
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end
