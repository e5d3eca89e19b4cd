"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, a straight line whose integral is 1. Its
cumulative demand at time t is target * integral(0..t); a document that covers words [a, b) of its
source's (repeated) stream gets the time at which the demand reaches the middle of that range.
Sorting by that position gives the training order.

The stream order within a source is a hash of the document, so it does not depend on how rows are
stored. Offsets in the stream are prefix sums in two levels: hash buckets first, rows in a bucket
second, so a source that holds a third of all rows is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, written


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(count_words(b.column(4)))], ["doc_id", "source", "k1", "k2", "size"])


def row_keys(id_col: str, text_col: str, source_col: str, others: Sequence[str] = ()) -> dict[str, Column]:
    """Two 64-bit hashes of a row's id, text, source and ``others``: its key and its place in the stream."""
    parts = [F.col(id_col).cast("long"), F.col(text_col), F.col(source_col).cast("string"), *[F.col(f"`{c}`") for c in others]]
    return {"k1": F.xxhash64(*parts), "k2": F.xxhash64(F.lit(7), *parts)}


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", others: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, k1, k2 and size in words of each row, in a scratch table."""
    keys = row_keys(id_col, text_col, source_col, others)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), keys["k1"].alias("k1"), keys["k2"].alias("k2"), F.col(text_col).cast("string").alias("text"))
    return written(cols.mapInArrow(_sizes, "doc_id long, source string, k1 long, k2 long, size long"), "mix-sizes")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_rows, source_size, weight, rank, target: one row per source.

    Sources by code point, null last, take the weights in turn. They share ``share`` times all words;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight
    until none is above: target = min(most * size, level * weight) for the one level that spends the
    total. The level is found by sorting sources by the level at which they fill up. This table has a
    row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(table, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    per = per.withColumn("cap", cap).withColumns({"full": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "total": F.lit(float(share)) * F.sum("source_size").over(everything)})
    # The level if exactly the sources before this one were full; the first that it does not fill fixes it.
    per = per.withColumn("level", F.try_divide(F.col("total") - F.col("full"), F.col("left")))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full", "level"))).over(everything).getField("level"))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_rows", "source_size", "weight", "rank", target.alias("target"))


def demand_time(share: Column, slope: Column) -> Column:
    """The time at which a line schedule 1 + slope * (2 t - 1) has integrated to ``share`` (0..1)."""
    # integral(t) = (1 - slope) t + slope t^2; the root in 0..1, written so that slope 0 needs no case
    b = F.lit(1.0) - slope
    return F.least(F.lit(1.0), F.try_divide(F.lit(2.0) * share, b + F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0)))))


def stream_offsets(sizes: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds begin: the words of its source that come before a row, in hash order."""
    buckets = max(16, sizes.count() // rows_per_bucket)  # only deals out the work; the order is the same for any count
    place = F.floor((F.col("k1").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(float(buckets)))
    keyed = sizes.withColumn("bucket", place.cast("long"))
    per = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_begin"))
    own = Window.partitionBy("source", "bucket").orderBy("k1", "k2", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = keyed.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return joined.withColumn("begin", F.col("bucket_begin") + F.col("inner")).drop("_s", "_b", "bucket", "inner", "bucket_begin")


def sources_fit(targets: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast (it is counted, not guessed)."""
    return targets.limit(most + 1).count() <= most


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, slopes: Sequence[float] = (-0.6, 0.0, 0.6), others: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, source, k1, k2, size, source_size, target, taken, positions.

    The stream of a source repeats up to ``most`` times. A row is taken on a pass if the middle of
    its word range there lies below the source's target, so a source's taken words differ from the
    target by at most half its largest document. taken is the words over all passes, positions has
    the training time (0..1) of each pass taken. ``slopes`` are the schedules, in turn like the
    weights: -1 falls to zero, 0 is flat, 1 rises from zero. A null text has size 0 and is never
    taken; a null source is a source; repeated rows are taken one by one; an empty table gives an
    empty result. k1 and k2 (row_keys) decide the order, so reruns agree; ``others`` are further columns
    that they cover.
    """
    sizes = sized(docs, id_col, text_col, source_col, others)
    targets = written(source_targets(sizes, weights, share, float(most)), "mix-targets")
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.pmod(F.col("rank") - 1, F.lit(len(slopes))) + 1).cast("int"))
    targets = targets.select(F.col("source").alias("_t"), "source_size", "target", slope.alias("slope"))
    small = F.broadcast(targets) if sources_fit(targets) else targets
    rows = stream_offsets(sizes).join(small, F.col("source").eqNullSafe(F.col("_t")))
    middle = lambda k: F.lit(k) * F.col("source_size") + F.col("begin") + F.col("size") / 2.0
    times = [F.when((F.col("size") > 0) & (middle(k) < F.col("target")), demand_time(F.try_divide(middle(k), F.col("target")), F.col("slope"))) for k in range(most)]
    rows = rows.withColumn("positions", F.array_compact(F.array(*times)))
    return rows.select("doc_id", "source", "k1", "k2", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with docs' own columns.

    The rows are range-sorted by position (ties by row key), so files written from them, read in
    order, are the curriculum. All columns are carried along and are part of the row key, so rows that
    differ in any column are placed one by one; rows equal in all columns are interchangeable, and each is
    placed. Columns are of types that xxhash64 takes (no maps).
    """
    own = docs.columns
    others = [c for c in own if c not in (id_col, text_col, source_col)]
    keys = row_keys(id_col, text_col, source_col, others)
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], keys["k1"].alias("_k1"), keys["k2"].alias("_k2"))
    taken = mix(docs, id_col, text_col, source_col, others=others, **options).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.explode("positions").alias("_at"))
    out = taken.join(renamed.dropDuplicates(["_k1", "_k2"]), ["_k1", "_k2"])
    out = out.repartitionByRange(F.col("_at"), F.col("_k1")).sortWithinPartitions("_at", "_k1", "_k2")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)])
