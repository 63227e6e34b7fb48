"""Analysis of files as they land.

Every finding and score depends on one file only, so a newly landed batch of files is
analysed by itself and no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from codestrata.operators import security
from codestrata.plans.analysis import Analysis
from codestrata.sources.corpus import analysable
from codestrata.sources.lines import explode_lines

FILES_SCHEMA = "file_id long, path string, content string"


def landed_files(spark: SparkSession, folder: str, schema: str = FILES_SCHEMA) -> DataFrame:
    """Stream of ``files`` from Parquet files that land in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def security_stream(files: DataFrame, path_aware: bool = False) -> DataFrame:
    """Security findings of a stream of files; a narrow, stateless plan."""
    return security.scan(explode_lines(analysable(files)), path_aware)


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one the cluster shares (``spark.checkpoint.dir``)."""
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}"


def analyse_landing(files: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Write ``issues`` and ``file_report`` of each batch below ``out``.

    A batch writes to folders of its own and overwrites them if it is run again, so a
    restart gives no duplicates.
    """

    def analyse(batch: DataFrame, batch_id: int) -> None:
        analysis = Analysis(batch)
        try:
            analysis.issues.write.mode("overwrite").parquet(f"{out}/issues/batch={batch_id}")
            analysis.file_report.write.mode("overwrite").parquet(
                f"{out}/file_report/batch={batch_id}")
        finally:
            analysis.release()

    return files.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
