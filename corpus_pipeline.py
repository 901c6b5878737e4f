"""The corpus pipeline: five stages over documents, each on all that the one before kept.

1. language_id: documents in no known language go (no letters, or a score below LEAST_SCORE); a missing lang is filled in.
2. line_dedup: lines that repeat across documents go, and documents of which nothing is left.
3. simhash_dedup: one document of each group of near copies stays.
4. decontaminate: documents that contain a benchmark item go.
5. packing: what is left becomes token sequences.

Every stage but the last takes and returns the columns of documents (doc_id, text, lang, source, n_chars); further columns of the
input, whatever their names, are not carried on. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm import decontaminate, language_id, line_dedup, packing, simhash_dedup
from splitboard.llm.text import fresh
from splitboard.sources import load, small_batches, stage

LEAST_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Null and empty texts and texts without a letter go; a null lang takes the prediction, another one
    stays as it is; repeated rows are judged alike; ties of probability take the first language in alphabetical order; where no row has a lang, all go.
    """
    found = language_id.identify(docs.select(*COLUMNS))
    known = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    with small_batches(spark):  # written here, since the batches' size counts when Spark plans the write
        return stage(known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS), "known-languages")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold, too; those of which only white space is left go, those without losses stay as they are.
    A null doc_id loses nothing; rows that share a doc_id count as one document and lose alike; n_chars is counted anew.
    """
    docs = docs.select(*COLUMNS)
    dropped = fresh(docs, "dropped")
    marked = line_dedup.with_bitmaps(docs, name=dropped)
    text = line_dedup.kept_text(F.col("text"), F.col(dropped))
    cleaned = marked.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(text))
    left = cleaned.where(F.col(dropped).isNull() | F.col("text").rlike(r"\S")).drop(dropped)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null ids last, ties by the text's hash; of repeated rows one.
    Null and empty texts are copies of each other. Candidates come from fingerprints in the Gray-order index and from keys of shingle sets; all are verified.
    """
    return simhash_dedup.one_of_each(docs.select(*COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; rows without a doc_id are judged like others, repeated rows alike."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as packing.SCHEMA names them. A null text is its closing id alone; repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [("language_id", languages), ("line_dedup", lines), ("simhash_dedup", near_copies), ("decontaminate", leaks), ("packing", sequences)]

#: No SQL: a trained network, fingerprints and a packing heuristic.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
