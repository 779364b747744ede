"""A corpus pipeline: language ID, line dedup, near duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and all but the
last return the columns of documents. run() writes each stage's result as Parquet in the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join, language, line_dedup, mixing, piece_codec
from gridloom.llm.common import stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that could be told go; the others get the predicted language."""
    names = docs.columns
    found = language.predict(docs, language.fit(docs))
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document holds first go; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it takes in part keeps the part's words."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids) of each row of the mix."""
    return piece_codec.encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("language ID", identify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", to_pieces),
]

#: SQL can express neither the first stage nor the last; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
