"""Five cleaning stages over ``documents``, each written as Parquet and read again.

Cases: every stage takes null and empty texts, repeated rows, empty tables and extra columns as its
operator does; extra columns go through all stages but the last. Texts that are null or without letters go
in the first stage; documents whose whole text repeats elsewhere go in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import bpe, langid, line_dedup, mixing, near_dup
from lexiquarry.llm.shared import fresh, scratch, table, unwritten

#: Least similarity, in hundredths, of near duplicates.
NEAR = 80


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages, one or several of them."""
    found = langid.detect(docs, langid.train(docs.select("lang", "text")))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; those of which nothing is left go."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    left = (F.col("removed_chunks") == 0) | (F.trim("text", F.lit(" \t\n\r")) != "")
    n_chars = F.when(F.col("removed_chunks") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cleaned.where(left).withColumn("n_chars", n_chars).select(docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    kept = near_dup.near_duplicates(docs.select("doc_id", "text"), NEAR).where("kept").select(F.col("doc_id").alias("stays"))
    return docs.join(kept.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(kept["stays"]), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mixing.mixed(docs).where("kept").select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining text."""
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), bpe.default_vocabulary()))


STAGES = [
    ("language ID", langid_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

#: Language mixtures, raking and merges by rank have no SQL form; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what a stage wrote on its way goes with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh(spark, f"stage{k}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            unwritten(before)
        docs = before = spark.read.schema(out.schema).parquet(path)
    return docs
