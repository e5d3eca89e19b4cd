"""Exact deduplication by skew-safe combining, in DataFrame operations only.

A digest that occurs once needs no comparison; digests are counted first, and a bit table of fixed size
lets the texts of repeated ones through (and a few others). Of those:

1. Copies are combined where they lie: a map-side partial aggregate keyed by digest, salt and the
   whole normalised text.
2. The salted groups are merged by one shuffle on the same key.
3. The salt winners (one row per digest, salt and text) are combined globally by digest and text.

Each stage groups by the full content next to the digest, so texts with one digest stay apart. A hot
text meets at most ``salts`` rows in stage 3, and its documents find their winner through (digest,
salt), so neither the merge nor the look-up has a task that grows with the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; a null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _marked(rows: DataFrame, checks: DataFrame, bits: int = 21) -> DataFrame:
    """Adds ``maybe``: whether a row's check value may be among ``checks``, by a broadcast table of 2 ** bits bits."""
    slot = F.pmod(F.col("check"), F.lit(1 << bits))
    table = checks.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    found = rows.join(F.broadcast(table), F.shiftright(slot, 6) == F.col("_word"), "left")
    return found.withColumn("maybe", F.expr(f"coalesce(shiftright(_bits, cast(pmod(check, {1 << bits}) & 63 as int)) & 1, 0) = 1")).drop("_word", "_bits")


def _digests(docs: DataFrame, id_col: str, text_col: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """Each row's id, digest, check value and salt; and the digests that occur more than once."""
    if not 1 <= salts <= 64:
        raise ValueError("salts must be between 1 and 64")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    base = base.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.xxhash64("norm").alias("check"))
    digests = written(base, "exact-digests")
    return digests, written(digests.groupBy("sha", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("check"), "exact-repeated")


def _classes(docs: DataFrame, digests: DataFrame, repeated: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    texts = _marked(texts.withColumn("check", F.xxhash64("norm")), repeated).where("maybe")
    texts = texts.withColumns({"sha": F.unhex(F.sha2("norm", 256)), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
    merged = texts.groupBy("sha", "check", "salt", "norm").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    final = merged.groupBy("sha", "check", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts_seen"))
    # The look-up is by digest and check value; contents that share both would be mixed up, so they stop the job.
    keyed = final.groupBy("sha", "check").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("salts_seen").alias("salts_seen"), F.count(F.lit(1)).alias("contents"))
    size = F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share SHA-256 and check value")).cast("long")).otherwise(F.col("group_size"))
    present = F.expr(f"filter(sequence(0, {salts - 1}), i -> (shiftright(salts_seen, i) & 1) = 1)")
    winners = keyed.select("sha", "check", "keep_id", size.alias("group_size"), F.explode(present).alias("salt"))
    # One winner row for each salt that its group has: at most one row per document, and no hot key.
    found = digests.join(winners, ["sha", "check", "salt"], "left")
    found = found.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept and text_sha256.

    Null text equals empty text. Of equal texts the row with the largest id stays; of rows that repeat
    an id, exactly the id counts (all its rows are kept or dropped together, and each adds to
    group_size). A null id is smaller than any other. Columns beside id and text are not read. An
    empty input gives an empty result. ``salts`` is at most 64.
    """
    digests, repeated = _digests(docs, id_col, text_col, salts)
    return _classes(docs, digests, repeated, id_col, text_col, salts)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row of docs, all columns, of each group of equal texts: one with the group's largest id.

    Of rows that repeat that id, the one with the smallest text before normalisation stays, then the one
    of the smallest hash of all columns. Rows of texts that occur once are not shuffled.
    """
    digests, repeated = _digests(docs, id_col, text_col, salts)
    kept = _classes(docs, digests, repeated, id_col, text_col, salts).where("kept").select(F.col("keep_id").alias("_kept"), F.col("text_sha256").alias("_kept_sha")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), normalised(F.col(text_col)).alias("norm"))
    marked = _marked(whole.withColumn("check", F.xxhash64("norm")), repeated)
    once = marked.where("not maybe").select("row.*")
    own = marked.where("maybe").withColumn("sha", F.sha2("norm", 256))
    best = own.join(kept, (F.col("sha") == F.col("_kept_sha")) & F.col("id").eqNullSafe(F.col("_kept")), "left_semi")
    best = best.groupBy("sha", "norm").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row")).select("row.*")
    return once.unionByName(best)
