"""The corpus pipeline: toxicity, exact copies, near copies, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table, written
from tesserae.llm.exact_dedup import exact_dedup
from tesserae.llm.jaccard_join import deduplicated
from tesserae.llm.mixing import mixed_documents
from tesserae.llm.packing import pack
from tesserae.llm.queries import tokenizer_files
from tesserae.llm.toxicity import toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Each row follows the score of its own id and text, rows without an id too.
    """
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), text_key=True)
    rejected = scores.where("predicted = 1").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
    return docs.join(rejected, docs["doc_id"].cast("long").eqNullSafe(rejected["_bad"]) & (F.xxhash64(docs["text"]) == rejected["_bad_key"]), "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect."""
    return deduplicated(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in curriculum order, each as often as the mix takes it."""
    return mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return pack(docs, *tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the connected components and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
