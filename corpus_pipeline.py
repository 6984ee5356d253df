"""A training corpus from the documents table: toxicity, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from rasterloom.llm.common import ascii_lower, materialise, table
from rasterloom.scratch import drop_scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model of the labels' training part.

    Null texts are scored as empty and stay if that is; repeated rows are scored alike. No column is added, so none can clash.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model) < toxicity.CUT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, equal after lowering A-Z: that of the largest doc_id, any one if rows repeat that id too.

    A null text is an empty one; a row without a doc_id stays only if no row with one has its text.
    """
    decided = exact_dedup.exact_dedup(docs).groupBy("doc_id", "text_sha256")
    # A text is told by its id and digest: rows that repeat an id may have several, of which some go.
    marked = materialise(decided.agg(F.bool_or("kept").alias("stays"), F.count("*").alias("many")).where("not stays or many > 1"))
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest.alias("digest")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.digest") == F.col("m.text_sha256"))
    rows = rows.join(marked.hint("merge").alias("m"), same, "left").where("stays is null or stays")
    once = rows.where("many is null").select("row.*")
    if marked.where("stays").isEmpty():
        return once
    return once.unionByName(rows.where("many is not null").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 over five-word shingles the one with the least doc_id.

    A document is a doc_id: rows that repeat one stay or go together. Rows without a doc_id, and texts without words, stay.
    """
    decided = minhash_dedup.near_duplicates(docs, shingle=5, percent=80)
    gone = decided.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the fractional repetition of a source rounded to a whole one.

    Documents without words are no part of any target and stay once. Rows that share an id are taken as often as the one of them that is taken most.
    """
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.max(times).alias("times")).where("times > 0").alias("t")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")).alias("d")
    met = rows.join(taken.hint("merge"), F.col("d.id").eqNullSafe(F.col("t.doc_id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input; what a stage wrote on its way is deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        mark = written(spark)
        docs = materialise(stage(spark, docs, sf_dir))
        last = written(spark)[-1]
        drop_scratch(spark, [p for p in written(spark) if p not in mark and p != last] + [p for p in (before,) if p])
        before = last
    return docs


#: Classifier, components and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None
