"""Clusters of colours as rows: families and roles, neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import near_black, near_white
from ..kernels.clusters import families


def cluster_roles(clusters: DataFrame) -> DataFrame:
    """Clusters (image_id, cluster, l, a, b, area) with chroma, is_near_white, is_near_black, family and role.

    Chromatic clusters closer than 18 in (a, b) are families, through others too; the largest of a
    family, and of the near-black ones, is base, the rest shading; near-white ones are neutral-light.
    """
    chroma = F.hypot("a", "b")
    flagged = clusters.withColumn("chroma", chroma).withColumn("is_near_white", near_white(F.col("l"), chroma)).withColumn("is_near_black", near_black(F.col("l"), chroma))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster", ignore_index=True)
        return pdf[["image_id", "cluster"]].assign(family=families(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["cluster"].to_numpy()))

    found = flagged.where("not is_near_white and not is_near_black").select("image_id", "cluster", "a", "b").groupBy("image_id").applyInPandas(group, "image_id long, cluster int, family int")
    out = flagged.join(found, ["image_id", "cluster"], "left")
    rank = lambda *by: F.row_number().over(Window.partitionBy("image_id", *by).orderBy(F.desc("area"), "cluster"))
    role = F.when(F.col("is_near_white"), "neutral-light").when(rank("is_near_white", "is_near_black", "family") == 1, "base").otherwise("shading")
    return out.withColumn("role", role)


def argmax_neighbour(tally: DataFrame, region: str = "region") -> DataFrame:
    """The neighbour with the longest border of each region, ties to the lowest cluster."""
    best = F.max_by(F.struct("neighbour", "n"), F.struct("n", -F.col("neighbour"))).alias("best")
    return tally.groupBy("image_id", region, "cluster").agg(best).select("image_id", region, "cluster", "best.neighbour", "best.n")
