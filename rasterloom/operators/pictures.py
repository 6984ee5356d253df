"""One kernel for each picture of a table (image_id, w, h, rgb)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that goes back.
ROWS = 16_384
#: Pictures, and pixels of them, that a kernel gets together.
TOGETHER, PIXELS = 64, 1 << 20


def per_picture(pictures: DataFrame, work: Callable[[int, np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that work(image_id, rgb) gives for each picture, rgb as height x width x 3 bytes.

    A picture is a row, so kernels need no shuffle and a lost executor costs its own pictures only. Pictures
    come in Arrow batches; where they are large, spark.sql.execution.arrow.maxRecordsPerBatch bounds a batch.
    """
    return _mapped(pictures, lambda batch: (row for image_id, rgb in batch for row in work(image_id, rgb)), schema, ROWS)


def per_pictures(pictures: DataFrame, work: Callable[[list[tuple[int, np.ndarray]]], Iterable[tuple]], schema: str) -> DataFrame:
    """As per_picture for a kernel that gets some pictures together, and whose rows go back with those of the next few."""
    return _mapped(pictures, work, schema, TOGETHER)


def _mapped(pictures: DataFrame, work: Callable[[list[tuple[int, np.ndarray]]], Iterable[tuple]], schema: str, most: int) -> DataFrame:
    """The rows of work(pictures), some pictures at a time; rows go back as soon as there are most of them."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def some(b: pa.RecordBatch):
        columns, found, size = [b.column(c) for c in ("image_id", "w", "h", "rgb")], [], 0
        for k in range(b.num_rows):
            image_id, w, h, data = (c[k].as_py() if j < 3 else c[k].as_buffer() for j, c in enumerate(columns))
            if found and (len(found) == TOGETHER or size + w * h > PIXELS):
                yield found
                found, size = [], 0
            found.append((image_id, np.frombuffer(data, np.uint8).reshape(h, w, 3)))
            size += w * h
        if found:
            yield found

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for few in some(b):
                rows.extend(work(few))
                if len(rows) >= most:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return pictures.select("image_id", "w", "h", "rgb").mapInArrow(run, schema)


def per_pixel(pictures: DataFrame, columns: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Pixel rows (image_id, x, y, idx, ...): the columns that a kernel gives for each pixel of a picture, with its place."""
    kinds = to_arrow_schema(StructType.fromDDL(f"image_id long, x int, y int, idx long, {schema}"))

    def run(batches):
        for b in batches:
            for image_id, w, h, data in zip(b.column("image_id").to_pylist(), b.column("w").to_pylist(), b.column("h").to_pylist(), b.column("rgb")):
                idx = np.arange(w * h, dtype=np.int64)
                found = columns(np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, 3))
                place = {"image_id": np.full(w * h, image_id, np.int64), "x": idx % w, "y": idx // w, "idx": idx}
                yield pa.RecordBatch.from_arrays([pa.array((place | found)[f.name], f.type) for f in kinds], schema=kinds)

    return pictures.select("image_id", "w", "h", "rgb").mapInArrow(run, f"image_id long, x int, y int, idx long, {schema}")


def pixels(pictures: DataFrame) -> DataFrame:
    """(image_id, x, y, idx, r, g, b) of every pixel."""
    return per_pixel(pictures, lambda rgb: {c: rgb[..., k].ravel() for k, c in enumerate("rgb")}, "r int, g int, b int")
