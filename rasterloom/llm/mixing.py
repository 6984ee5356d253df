"""Mixing sources to target weights by capped water-filling; built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import with_position
from .common import WORD, materialise, table

BUCKETS = 4096


def source_targets(sizes: DataFrame, share: float, max_epochs: int, weights: tuple[float, ...]) -> DataFrame:
    """Targets of sources (source, source_size): share of all sizes, dealt by weight in the order of code points, null last, none above max_epochs sizes.

    Water-filling: sources whose share by weight exceeds their cap are clamped at it, and what they can't
    take is dealt to the others by weight, until none is above. The level (size for each unit of weight) only rises, so
    a clamped source stays so; each round is one aggregate over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = with_position(sizes, F.col("source").asc_nulls_last())
    placed = materialise(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)))
    whole = placed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        clamped, free = placed.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            return placed.select("source", "source_size", F.col("cap").alias("target"))
        level, before = max(level, (whole * share - (clamped or 0.0)) / free), level
    return placed.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, *, share: float = 1.5, max_epochs: int = 2, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How many words of each document a mixture takes: (doc_id, size, source_size, target, taken).

    A source is repeated whole floor(target / size) times; the fraction left over is drawn without
    replacement in a seeded order of its documents. The document at which the draw meets the target
    gives a fractional repetition, so that a source's taken words are its target, rounded.
    The order is dealt over buckets of the seeded digest: bucket totals place each bucket in its
    source's order, and only within (source, bucket) are rows ranked, so a hot source is spread over
    thousands of tasks. Only ids, sources and sizes are shuffled, never texts.

    A null text has size 0. A null source is a source of its own and comes last. Rows that share an
    id are separate rows that are drawn next to each other. An empty table gives no rows. Other
    columns of docs are ignored.
    """
    thin = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("draw"),
    )
    thin = materialise(thin.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int") % BUCKETS))
    buckets = thin.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, max_epochs, weights)
    placed = buckets.withColumn(
        "before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("bucket_size")
    placed = placed.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "bucket", "before", "source_size", "target")
    rows = thin.alias("d").join(placed.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    rows = rows.select("d.doc_id", "d.source", "d.bucket", "d.draw", "d.size", "before", "source_size", "target")
    rank = Window.partitionBy("source", "bucket").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(rank), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    need = F.floor(F.col("target") + F.lit(0.5)) - whole * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), need - upto))
    return rows.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS share FROM s
), fill(step, level) AS (
  SELECT 0, (SELECT max(share) / sum(weight) FROM w)
  UNION ALL
  SELECT step + 1, (SELECT (max(share) - coalesce(sum(cap) FILTER (WHERE level * weight > cap), 0)) / nullif(sum(weight) FILTER (WHERE level * weight <= cap), 0) FROM w)
  FROM fill WHERE step < 40 AND level IS NOT NULL
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM fill WHERE level IS NOT NULL ORDER BY step DESC LIMIT 1) * weight), cap) AS target FROM w
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) - whole * source_size - upto)) AS BIGINT) AS taken
FROM r
"""
