"""Cut lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; where that is unset, a temporary one of a local master, and else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/rasterloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: what follows reads it any number of times, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables that materialise() has written in this application, in order, without deleted ones."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes these tables of materialise(), by default all of this application; frames that read them are lost."""
    known = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    for name in known if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    known[:] = [] if paths is None else [p for p in known if p not in paths]
