"""Product pictures derived from the part table by a closed formula, one for every row, in six sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import PICTURE


def draw(image_id: int, size: int) -> np.ndarray:
    """The picture of a part: rules from the last to the first, so that the first that matches a pixel decides."""
    h, w = 48 + 6 * (image_id % 2), 48 + 6 * (image_id % 3)
    odd, half = image_id // 6 % 2, 10 + size % 6
    light, dark = (120 + size % 50, 20 + size, 30), (60 + size % 50, 10, 15)
    rgb = np.empty((h, w, 3), np.uint8)
    rgb[:] = light
    rgb[:, 25:] = dark
    rgb[12, 31] = light
    rgb[18:29, 18] = rgb[22, 26:30] = rgb[10:15, 16:21] = rgb[33:38] = 245
    rgb[[6, 38]] = rgb[:, [24 - half, 24 + half]] = 12
    body = np.zeros((h, w), bool)
    body[6:39, 24 - half : 25 + half] = True
    rgb[~body] = 255
    if odd:
        rgb[38:40, 24 - half - 6 : 24 + half + 7] = 200
    else:
        rgb[42:45, 24 - half - 3 : 24 + half + 4] = 200
    return rgb


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, w, h, rgb) of every row of part; rgb holds three bytes a pixel, row by row. Pictures are dealt out before they are drawn."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), "p_size")
    part = part.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "image_id")

    def make(batches):
        for batch in batches:
            ids, sizes = (batch.column(c).to_pylist() for c in ("image_id", "p_size"))
            for at in range(0, len(ids), 256):
                drawn = [draw(i, s) for i, s in zip(ids[at : at + 256], sizes[at : at + 256])]
                columns = [ids[at : at + 256], [p.shape[1] for p in drawn], [p.shape[0] for p in drawn], [p.tobytes() for p in drawn]]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["image_id", "w", "h", "rgb"])

    return part.mapInArrow(make, PICTURE)
