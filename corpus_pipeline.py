"""From raw documents to sampled token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before kept, and gives the columns of documents, but for the last, which gives
doc_id and ids.

Defined results: rows with nulls are kept unless a stage's rule is about them,
so one without a text goes, as it has no language, and one without an id is no
copy of any other; repeated rows are kept or go together; very long texts are
taken whole; ties are settled as the operators say; empty tables give empty
tables; columns beside those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import common, langid, linededup, minhash, mixing, pieces

#: A document whose language is undetermined, or less sure than this, is rejected.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language."""
    pred, score = common.fresh(docs, "lang_pred", "score")
    told = langid.with_language(docs, pred=pred, score=score)
    return told.filter((F.col(pred) != "und") & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many documents share from all but one of them."""
    done = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    (name,) = common.fresh(docs, "gone")
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by source to the target weights; one taken twice is there twice."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return pieces.encode(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: A trained network and a sampler are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = common.materialize(docs)
    return docs
