"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios, read in windows.

A window's features are the character 4-, 6- and 8-grams of its lower-cased text, each present or not;
characters are code points. An n-gram is known by its size and a 64-bit hash of its code points. Training
finds, for each n-gram, the log ratio of its share in toxic and in other texts; a logistic regression is
then fitted to the features multiplied by their ratio. A text's score is that of its most toxic window of
two blocks of ``BLOCK`` characters, in training as well, so that it does not grow with the text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, chunks, crc_mod, mix64, written

SIZES = (4, 6, 8)
#: Characters. A window starts at each block but the last and ends with the next block.
BLOCK = 512
#: Keys that one task counts before it hands them on.
FLUSH = 1 << 22
#: Bits of the table that passes over most n-grams that are not kept; keys are compared after it.
SIEVE = 20
#: A fixed value: an odd multiplier.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: A fixed value: the odd base of the n-grams' hash.
_GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased (A-Z) code points of UTF-8 texts and their offsets."""
    if not (data & 0x80).any():
        return LOWER[data].astype(np.uint64), offs
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = LOWER[data[lead]].astype(np.uint64)
    size = np.diff(np.append(lead, len(data)))
    out = np.where(size == 1, first, first & (np.uint64(0x7F) >> size.astype(np.uint64)))
    for i in range(1, 4):
        at = np.flatnonzero(size > i)
        out[at] = (out[at] << np.uint64(6)) | (data[lead[at] + i] & 0x3F)
    return out, np.searchsorted(lead, offs)


def gram_keys(chars: np.ndarray):
    """For each size, a hash of the n-gram that starts at each character (n - 1 fewer than characters)."""
    for n in SIZES:
        key = np.zeros(max(0, len(chars) - n + 1), np.uint64)
        for i in range(n if len(key) else 0):
            key *= _GRAM_BASE
            key += chars[i : i + len(key)] + np.uint64(1)
        yield mix64(key)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first, axis=0, dtype=np.int32) if len(keys) else counts


def _count(batches):
    """(n, gram, toxic, other): in how many texts of either label each n-gram is; an n-gram may come again."""
    held = {n: [] for n in SIZES}
    rows = 0

    def flushed():
        for n, parts in held.items():
            if parts:
                keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                for lo in range(0, len(keys), 1 << 16):
                    k, c = keys[lo : lo + (1 << 16)], counts[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(c[:, 1]), pa.array(c[:, 0])], ["n", "gram", "toxic", "other"])
            held[n] = []

    for b in batches:
        labels = b.column(0).to_numpy()
        for lo, _, data, offs in chunks(b.column(1)):
            chars, offs = code_points(data, offs)
            for n, keys in zip(SIZES, gram_keys(chars), strict=True):
                found = [np.unique(keys[a : max(a, e - n + 1)]) for a, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                label = np.repeat(labels[lo : lo + len(found)], [len(x) for x in found])
                held[n].append(_summed(np.concatenate(found), np.stack([label == 0, label == 1], axis=1).astype(np.int32)))
                rows += len(held[n][-1][0])
            if rows >= FLUSH:
                yield from flushed()
                rows = 0
    yield from flushed()


class Kept:
    """The n-grams that are kept, found in texts by their keys."""

    def __init__(self, n: np.ndarray, gram: np.ndarray):
        """n and gram: sizes and keys, ascending by both (keys unsigned)."""
        self.parts = []
        for size in SIZES:
            at = np.flatnonzero(n == size)
            keys = gram[at].astype(np.uint64)
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[self._slot(keys)] = True
            self.parts.append((size, keys, sieve, int(at[0]) if len(at) else 0))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER) >> np.uint64(64 - SIEVE)

    def windows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's windows begin among all windows, and (window, feature) pairs, distinct."""
        chars, offs = code_points(data, offs)
        blocks = -(-np.diff(offs) // BLOCK)
        first = np.concatenate(([0], np.cumsum(np.maximum(1, blocks - 1))))
        pairs = [np.zeros(0, np.int64)]
        total = sum(len(keys) for _, keys, _, _ in self.parts)
        for (n, keys, sieve, base), key in zip(self.parts, gram_keys(chars), strict=True):
            at = np.flatnonzero(sieve[self._slot(key)]) if len(keys) else np.zeros(0, np.int64)
            if not len(at):
                continue
            i = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            row = np.searchsorted(offs, at, "right") - 1
            ok = (keys[i] == key[at]) & (at + n <= offs[row + 1])
            at, i, row = at[ok], i[ok] + base, row[ok]
            block = (at - offs[row]) // BLOCK
            for w in (block - 1, block):
                ok = (w >= 0) & (first[row] + w < first[row + 1])
                pairs.append((first[row[ok]] + w[ok]) * total + i[ok])
        pairs = np.unique(np.concatenate(pairs))
        return first, pairs // max(1, total), pairs % max(1, total)


def _best(kept: Kept, weights: np.ndarray):
    """The features of each text's window of the largest score (the first of equal ones)."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(2)):
                first, window, feature = kept.windows(data, offs)
                score = np.bincount(window, weights[feature], first[-1])
                best = [p + int(score[p:q].argmax()) for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                rows = [feature[p:q].astype("<i4").tobytes() for p, q in zip(np.searchsorted(window, best), np.searchsorted(window, best, "right"), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["label", "weight", "features"])

    return run


def fit(of: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, start: tuple[np.ndarray, float], steps: int = 100, penalty: float = 3.0, rate: float = 0.05, per_part: int = 1 << 17) -> tuple[np.ndarray, float]:
    """Coefficients of the ratios and an intercept, improved from ``start``.

    Row i has the features ``of[bounds[i] : bounds[i + 1]]``. Rows are taken in parts of about ``per_part``
    features, so that a step needs little memory beside them.
    """
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, len(of), per_part)), len(y)))
    w, b = start
    mw, vw, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):  # Adam over all rows
        scaled, g, gb = w * ratio, penalty * w / total, 0.0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = of[bounds[lo] : bounds[hi]]
            row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
            f = b + np.bincount(row, scaled[part], hi - lo)
            e = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(f, -35, 35))) - y[lo:hi]) / total
            g += np.bincount(part, e[row], len(w)) * ratio
            gb += e.sum()
        mw, vw = 0.9 * mw + 0.1 * g, 0.999 * vw + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 5, sample: int = 5_000, surprise: float = 4.0, rounds: int = 3) -> tuple[Kept, np.ndarray, float]:
    """Fits on at most ``sample`` rows of each label (by a hash of the id) whose crc32(id) mod ``held_out`` is not 0.

    The sample's texts are counted on the executors. The driver gets the n-grams whose count in toxic
    texts is ``surprise`` standard deviations from chance. A text counts as its most toxic window, which
    the executors look for again in each of ``rounds`` (at first by the ratios); the driver gets which
    n-grams that window has, at most 3 numbers a character of ``2 * sample`` windows. Rows are weighted by how many of their label there are. An id labelled
    more than once counts with its largest label; null ids and labels are left out. Without texts of
    both labels: no weights, the intercept of the share.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (crc_mod(F.col("doc_id"), held_out) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    parts = [known.where(F.col("_label") == k).orderBy(*order).limit(sample).withColumn("_weight", F.lit(max(1.0, counts.get(k, 0) / sample))) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # two times the sample at most
    texts = written(docs.join(F.broadcast(chosen), F.col(id_col).cast("long") == F.col("_id")).select(F.col("_label").alias("label"), F.col("_weight").alias("weight"), F.col(text_col).cast("string").alias("text")), "toxicity-sample")
    size = {r["label"]: (r["n"], r["weight"]) for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()}
    (n1, w1), (n0, w0) = size.get(1, (0, 0.0)), size.get(0, (0, 0.0))
    n, gram, ratio = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0)
    if n1 and n0:
        grams = texts.select("label", "text").mapInArrow(_count, "n int, gram long, toxic int, other int").groupBy("n", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        expected = (F.col("toxic") + F.col("other")) * F.lit(n1 / (n1 + n0))
        told = grams.where(F.abs(F.col("toxic") - expected) >= F.lit(surprise) * F.sqrt(expected)).toArrow()
        n, gram = told.column("n").to_numpy(), told.column("gram").to_numpy().view(np.uint64)
        p, q = (told.column("toxic").to_numpy() + 0.5) / (n1 + 1), (told.column("other").to_numpy() + 0.5) / (n0 + 1)
        order = np.lexsort((gram, n))
        n, gram, ratio = n[order], gram[order], np.log(p / q)[order]
    kept, weights = Kept(n, gram), ratio
    share = (w1 + 0.5) / (w0 + w1 + 1)
    found = np.zeros(len(ratio)), float(np.log(share / (1 - share)))
    for _ in range(rounds if len(ratio) else 0):
        got = texts.mapInArrow(_best(kept, weights), "label int, weight double, features binary").toArrow()
        raw, offs = buffers(got.column("features"))
        found = fit(raw.view("<i4"), offs // 4, got.column("label").to_numpy().astype(np.float64), got.column("weight").to_numpy().astype(np.float64), ratio, found)
        weights = found[0] * ratio
    return kept, weights, found[1]


def _score(kept: Kept, weights: np.ndarray, intercept: float):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                first, window, feature = kept.windows(data, offs)
                f = intercept + np.maximum.reduceat(np.bincount(window, weights[feature], first[-1]), first[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(f, -35, 35)))), b.column(2).slice(lo, hi - lo)], ["doc_id", "score", "text_key"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5, threshold: float = 0.5, sample: int = 5_000, text_key: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted; with ``text_key`` also a hash of the text.

    Only the text decides a score, by its most toxic window; a null text is an empty one and has a
    score too. A null id is not held out. Repeated rows are scored one by one, an empty table gives an
    empty result, other columns are not read.
    """
    kept, weights, intercept = train(docs, labels, id_col, text_col, held_out=held_out, sample=sample)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    out = cols.mapInArrow(_score(kept, weights, intercept), "doc_id long, score double, text_key long")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["text_key"] * text_key)
