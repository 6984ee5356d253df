"""Image files in, vector files out."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import supported
from ..operators.order import with_position

PICTURE = "image_id long, w int, h int, rgb binary"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def split_supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (name, mime) that can be read and those that cannot; a batch goes on without the latter."""
    ok = F.coalesce(supported(F.col("name"), F.col("mime")), F.lit(False))
    return files.where(ok), files.where(~ok)


def jobs(files: DataFrame, order: Column, millis: int) -> DataFrame:
    """files with job_id (job, running number from 1, time in milliseconds) and status pending, numbered in the order."""
    numbered = with_position(files, order, name="_job")
    job = F.concat(F.lit("job-"), (F.col("_job") + 1).cast("string"), F.lit(f"-{millis}"))
    return numbered.withColumn("job_id", job).withColumn("status", F.lit("pending")).drop("_job")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/")


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pictures (image_id, path, w, h, rgb) of a folder's images, and (path) of those that cannot be decoded.

    Decoding runs in the JVM, with the formats of its image reader; alpha is dropped, gray spread over three
    channels. image_id numbers paths in their order, from the listing alone.
    """
    listed = spark.read.format("binaryFile").load(path).select(_plain(F.col("path")).alias("path"))
    ids = with_position(listed, F.col("path"), name="image_id")
    images = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    images = images.withColumn("path", _plain(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))))
    good, bad = images.where("width > 0"), images.where("width <= 0").select("path")

    def unpack(batches):
        for b in batches:
            out = []
            for w, h, n, data in zip(*(b.column(c).to_pylist() for c in ("width", "height", "nChannels", "data"))):
                cells = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append(np.ascontiguousarray(cells[..., 2::-1] if n > 1 else np.repeat(cells, 3, axis=2)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("image_id", "path", "width", "height")] + [pa.array(out, pa.binary())], names=["image_id", "path", "w", "h", "rgb"])

    rows = good.join(ids, "path").select("image_id", "path", "width", "height", "nChannels", "data")
    return rows.mapInArrow(unpack, "image_id long, path string, w int, h int, rgb binary"), bad


def write_svgs(svgs: DataFrame, path: str) -> None:
    """One text file for each image (name, svg), in folders name=..., written by the executors."""
    svgs.select("name", F.col("svg").alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def zip_archives(svgs: DataFrame) -> DataFrame:
    """(batch, archive): a ZIP of the (batch, name, svg) rows of each batch; a batch must fit in a task."""

    def archive(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, svg in pdf.sort_values("name")[["name", "svg"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name), svg)
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "archive": [out.getvalue()]})

    return svgs.groupBy("batch").applyInPandas(archive, "batch long, archive binary")
