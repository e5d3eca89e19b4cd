"""The operators' queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digests, format_conversations
from .common import table
from .exact_dedup import exact_classes
from .jaccard_join import near_duplicates
from .language_id import language_id
from .mixing import mix
from .packing import pack
from .pii import pseudonymised
from .quality_model import quality_scores
from .quality_rules import quality_rules
from .toxicity import toxicity_scores

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The setting that op2's query takes its key from. Without it the key is a public one, for tests alone.
PII_KEY = "spark.tesserae.pii.key"


def tokenizer_files(folder: str | None = None) -> tuple[str, str]:
    """The tokenizer's two files: in ``folder``, or where the package of public tokenizers has them."""
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    if folder:
        return f"{folder}/{names[0]}", f"{folder}/{names[1]}"
    import public_tokenizers

    return public_tokenizers.path(names[0]), public_tokenizers.path(names[1])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), key=spark.conf.get(PII_KEY, "test key"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    broken = F.raise_error(F.lit("a formatted conversation does not parse back to its source")).cast("long")
    return digests(format_conversations(rows)).withColumn("n_turns", F.when(F.col("round_trip"), F.col("n_turns")).otherwise(broken)).drop("round_trip")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_quality_model": op9_quality_model,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": f"""
        WITH base AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents),
             sized AS (SELECT doc_id, sha256(norm) AS text_sha256, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM base)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM sized""",
    "op10_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g')) + 20 AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
