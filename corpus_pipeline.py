"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all rows that its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, line_dedup, mixing, quality, simhash
from rivulet.llm.common import table, without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones of its input that aren't held out.

    Null texts are judged as empty ones; repeated rows are judged alike. Without labels all stay.
    """
    rows = written(quality.with_statistics(docs.select(COLUMNS)), "statistics")
    model = quality.train_on(rows.select(F.col("doc_id").alias("id"), "x"), table(spark, sf_dir, "labels"))
    return quality.keep_good(rows, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars follows the text. None is dropped.

    Null texts become empty. Rows that share an id are one document, null ids the last one.
    """
    got = line_dedup.dedup_lines(docs.select(COLUMNS))
    return got.select("doc_id", F.col("line_dedup.text").alias("text"), "lang", "source", F.length("line_dedup.text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) the document with the smallest id.

    Texts without words are one group. Rows that share an id stay or go together; rows without id stay.
    """
    groups = simhash.near_duplicates(docs, words_in_shingle=5, similarity=0.8)
    away = written(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "away")
    return without(docs.select(COLUMNS), away, "doc_id")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null texts hold none; repeated rows are judged alike."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are taken, with their size in words, their source's target, copies and words taken.

    Rows that agree in id, source and text get the same number of copies, the largest that any of them was drawn for; other rows
    that share an id, or have none, are drawn on their own.
    """
    drawn = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"))
    taken = written(drawn.agg(F.max("target").alias("target"), F.max("copies").alias("copies"), F.max("size").alias("size")).where("copies > 0"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.select(COLUMNS).join(taken, same).select(*COLUMNS, "size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the classifier, the fingerprints and the draws; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
