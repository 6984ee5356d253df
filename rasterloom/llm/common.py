"""What the operators share: tables, cut lineage, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

#: Different links, of 16 bytes each, up to which one task joins them; more are joined by steps of aggregates and joins, with the same result.
ONE_TASK = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 256):
    """Arrow batches in parts, so that a worker turns the texts of a few rows at a time into Python objects and arrays."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(col) -> F.Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _join_links(batches):
    """(node, component) of all links (u, v) of the batches: roots hook onto lesser roots until no link joins two."""
    links = [np.stack([b.column(c).to_numpy() for c in "uv"]) for b in batches if b.num_rows]
    if not links:
        return
    nodes, ends = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    ends, root = ends.reshape(2, -1), np.arange(len(nodes))
    while (apart := root[ends[0]] != root[ends[1]]).any():
        a, b = root[ends[:, apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (node, component), component the least node.

    Up to ONE_TASK links are joined in one task. Beyond, large-star and small-star steps alternate until the links
    no longer change. Every step is an aggregate and an equi-join on thin rows. The aggregates are written
    first, so that both sides of a join are plain shuffles and AQE can split a hub's links.
    """
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    )
    mark = _mark(e)
    if mark[0] <= ONE_TASK:
        return e.coalesce(1).mapInArrow(_join_links, "node long, component long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialise(both.join(low.hint("merge"), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low.hint("merge"), "u")
        e = materialise(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        mark, before = _mark(e), mark
        if mark == before:
            break
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
