"""Packing documents into sequences: cutting stock by column generation.

1. Every document is tokenised and cut into whole sequences and one rest. A rest counts as its length
   in units of ``grain`` tokens, rounded up: the histogram of rests has sequence / grain classes.
2. A linear program chooses how often to use each pattern (a multiset of classes that fits into one
   sequence) so that the fewest sequences hold the histogram. Patterns are generated as needed: a
   knapsack dynamic program finds the pattern of the largest value at the program's prices. The
   program's size depends on the number of classes only, not on the corpus.
3. Pattern counts are rounded down; what is left, less than a sequence per pattern, is filled greedily.
4. The rests of a class are ranked, and a rank belongs to one place of one copy of one pattern, which
   is found by a binary search in a table of a few thousand rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import chunks, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (ascending) that fits: unbounded knapsack."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        value[w] = value[w - 1]
        if k := fits[w]:
            gain = value[w - sizes[:k]] + prices[:k]
            i = int(gain.argmax())
            if gain[i] > value[w] + 1e-12:
                value[w], choice[w] = gain[i], i
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(value[room]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse of a matrix, by elimination with row pivots."""
    n = len(a)
    m = np.hstack([a, np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        factor = m[:, k].copy()
        factor[k] = 0
        m -= np.outer(factor, m[k])
    return m[:, n:]


def patterns(demand: dict[int, int], room: int, gap: float = 1e-4, rounds: int = 5000) -> list[tuple[dict[int, int], int]]:
    """(pattern, copies) pairs that hold exactly the demand: size -> pieces.

    The simplex method over generated columns, ended when the price bound shows that the relaxed
    program is within ``gap`` of its optimum; an error if ``rounds`` are not enough. Elementwise products
    only: a threaded BLAS can stall beside the driver's JVM.
    """
    sizes = np.array(sorted(s for s, d in demand.items() if d > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], np.float64)
    shaken = need + 1e-6 * np.arange(1, len(need) + 1) / len(need)  # no two ratios tie, so no basis comes twice
    columns = np.diag(room // sizes).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(columns))
    for step in range(rounds):
        used = (inverse * shaken).sum(axis=1)
        value, column = best_pattern(sizes, inverse.sum(axis=0), room)
        if value <= 1 + gap:
            break
        way = (inverse * column).sum(axis=1)
        ratio = np.full(len(way), np.inf)
        np.divide(np.maximum(used, 0), way, out=ratio, where=way > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        if step % 100 == 99:
            inverse = inverted(columns)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    else:
        raise RuntimeError(f"no packing within {gap} of the optimum after {rounds} rounds")
    copies = np.floor(np.maximum((inverse * need).sum(axis=1), 0) + 1e-6).astype(np.int64)
    while (over := (columns.astype(np.int64) * copies).sum(axis=1) - need.astype(np.int64)).max() > 0:  # rounding noise only
        copies[int(np.flatnonzero(columns[int(over.argmax())] * copies)[0])] -= 1
    found = [({int(sizes[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}, int(copies[j])) for j in np.flatnonzero(copies)]
    left = {int(s): int(d) for s, d in zip(sizes, -over, strict=True) if d}
    while left:
        free, one = room, {}
        for s in sorted(left, reverse=True):
            if k := min(left[s], free // s):
                one[s] = k
                free -= k * s
        times = min(left[s] // k for s, k in one.items())
        found.append((one, times))
        left = {s: d for s, n in left.items() if (d := n - times * one.get(s, 0))}
    return found


def _cut(files: tuple[str, str], size: int, end: int):
    def run(batches):
        encoder = Encoder(*files)
        for b in batches:
            ids_of = b.column(0).fill_null(0).to_numpy()
            unknown = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(b.column(1)):
                ids, bounds = encoder.encode(data, offs)
                n = np.diff(bounds) + 1
                tokens = np.full(len(ids) + hi - lo, end, "<u4")
                first = bounds[:-1] + np.arange(hi - lo)
                place = np.ones(len(tokens), bool)
                place[first + n - 1] = False
                tokens[place] = ids
                count = -(-n // size)
                doc = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(size, n[doc] - start)
                at = first[doc] + start
                raw = memoryview(tokens).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
                ids_now = pa.array(ids_of[lo:hi][doc], mask=unknown[lo:hi][doc])
                yield pa.RecordBatch.from_arrays([ids_now, pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc), pa.array(n[doc].astype(np.int64))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cut(docs: DataFrame, tokenizer_json: str, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = 0) -> DataFrame:
    """The pieces of each document: whole sequences of ``size`` ids from its start, then the rest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cut((tokenizer_json, ranks_file), size, end), PIECES)


def _ranked(pieces: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds rank: 0, 1, .. within a class, by a hash of the piece; a large class is split over buckets."""
    buckets = max(16, pieces.count() // rows_per_bucket)
    keyed = pieces.withColumn("h", F.xxhash64("doc_id", "start")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    per = keyed.groupBy("units", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("units", "bucket").orderBy("h", "doc_id", "start", "length", "ids_crc32")
    return keyed.withColumn("nth", F.row_number().over(own)).join(per, ["units", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("h", "bucket", "nth", "before")


def _places(found: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: the first rank of each pattern that has it, its places per copy, the first sequence."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for one, copies in found:
        for s, k in one.items():
            out.setdefault(s, []).append((taken.get(s, 0), k, sequence))
            taken[s] = taken.get(s, 0) + k * copies
        sequence += copies
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}


def _assign(places, whole: int, first_whole: int):
    def run(batches):
        for b in batches:
            units, rank = b.column("units").to_numpy(), b.column("rank").to_numpy()
            sequence = np.where(units == whole, first_whole + rank, 0)
            for u in np.unique(units):
                if u in places:
                    lows, per, first = places[u]
                    rows = np.flatnonzero(units == u)
                    k = np.searchsorted(lows, rank[rows], "right") - 1
                    sequence[rows] = first[k] + (rank[rows] - lows[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), b.column("units"), b.column("rank")], [*b.schema.names[:5], "sequence_id", "units", "rank"])

    return run


def pack(docs: DataFrame, tokenizer_json: str, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, grain: int = 8, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, the end id. Repeated rows are documents of their own. A null id
    stays null. Only id and text are read. An empty table gives an empty result. A sequence's pieces
    lie end to end from offset 0, longest class first; sequence ids run from 0 without gaps.
    """
    whole = -(-size // grain)
    pieces = written(cut(docs, tokenizer_json, ranks_file, id_col, text_col, size, end), "pack-pieces")
    pieces = pieces.withColumn("units", F.ceil(F.col("length") / F.lit(grain)).cast("long"))
    histogram = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size / grain rows
    found = patterns({u: n for u, n in histogram.items() if u != whole}, size // grain)
    places = {s: tuple(v) for s, v in _places(found).items()}
    rows = _ranked(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", "rank")
    schema = PIECES + ", sequence_id long, units long, rank long"
    placed = written(rows.mapInArrow(_assign(places, whole, sum(c for _, c in found)), schema), "pack-places")
    order = Window.partitionBy("sequence_id").orderBy(F.col("units").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rests = placed.where(F.col("units") != whole).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    out = placed.where(F.col("units") == whole).withColumn("offset", F.lit(0).cast("long")).unionByName(rests)
    return out.drop("units", "rank")
