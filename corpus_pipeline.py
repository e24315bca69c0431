"""Cleaning of a corpus in stages; each stage's result is the next one's input.

quality, near duplicates, benchmark leaks, personal data, packing. The first four
return the columns of ``documents``, the last one pieces of sequences. Rows without
id take part in every stage but cannot be named by it, so the near-duplicate and
the leak stage keep them; rows that repeat an id stay or go together. Extra columns
are passed on by the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, neardup, packing, pii, quality_cnn
from tidemark.llm.tables import documents, table
from tidemark.session import materialize

#: near duplicates: words of a shingle, and similarity in percent
SHINGLE, SIMILARITY = 5, 80
#: words whose ids a Python worker keeps, in each of two generations; workers that ran one stage run
#: the others as well, so this table stays small
KEPT_WORDS = 150_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network accepts."""
    return quality_cnn.keep_good(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id."""
    found = neardup.near_duplicates(docs, SHINGLE, SIMILARITY)
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and the length of what is left."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences along the curve."""
    return packing.pack_documents(docs, packing.word_bpe(), keep=KEPT_WORDS)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_leaks),
    ("personal data", redact_personal),
    ("packing", pack),
]

#: the network, the trees and the tokenizer have no equal in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
