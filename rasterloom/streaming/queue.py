"""The queue of pictures as a stream: files that arrive are converted batch by batch, a bad one does not stop the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import supported

FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def watch(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """(path, name, length, content) of supported image files, as they appear in the folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    name = F.substring_index("path", "/", -1)
    return files.withColumn("name", name).where(supported(name, F.lit(""))).drop("modificationTime")


def convert(files: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs work on each batch and appends its result as Parquet under out/batch=N; a batch that is repeated replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_status(jobs: DataFrame) -> DataFrame:
    """(status, jobs) counts of a batch's jobs."""
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))
