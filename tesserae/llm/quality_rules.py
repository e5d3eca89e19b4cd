"""Quality rules: divergence of a document's histograms from language references.

A document's histogram of character classes and its histogram of common words are compared, by the
Jensen-Shannon distance, with those of each language. A language's reference comes from all its
documents that pass the base rules. A document is close enough if its nearest language is. Short texts
have noisy histograms: below ``min_words`` the distances decide nothing, and above it the limit on the
distance of common words falls with the root of the word count, as the noise does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .profile import CLASSES, Profile

#: Words are counted in this many hashed slots per language; the common words are the fullest slots.
SLOTS = 4096


def base_failed(p: Profile) -> np.ndarray:
    return (p.n_words < 20) | (100 * p.n_repeat_words > 30 * p.n_words)


def _slots(p: Profile) -> np.ndarray:
    return (p.word_hash & np.uint64(SLOTS - 1)).astype(np.int64)


def _gather(min_words: int):
    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = b.column(0).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(b.column(1)):
                p = Profile(data, offs)
                fine = ~base_failed(p) & (p.n_words >= min_words) & (of[lo:hi] >= 0)
                slots = _slots(p)
                for k in np.unique(of[lo:hi][fine]):
                    mine = fine & (of[lo:hi] == k)
                    classes, words = total.setdefault(names[k], (np.zeros(len(CLASSES), np.int64), np.zeros(SLOTS, np.int64)))
                    classes += p.classes[mine].sum(axis=0)
                    words += np.bincount(slots[mine[p.word_doc]], minlength=SLOTS)
        for name, (classes, words) in total.items():
            both = np.concatenate([classes, words])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(both[at])], ["lang", "slot", "n"])

    return run


class References:
    """Per language: shares of character classes, the slots of common words and their shares, the rest last."""

    def __init__(self, rows, common: int):
        by: dict[str, np.ndarray] = {}
        for lang, slot, n in rows:
            by.setdefault(lang, np.zeros(len(CLASSES) + SLOTS))[slot] = n
        self.langs = sorted(by)
        self.classes, self.lookup, self.words = [], [], []
        for lang in self.langs:
            c, w = by[lang][: len(CLASSES)], by[lang][len(CLASSES) :]
            top = np.lexsort((np.arange(SLOTS), -w))[:common]
            look = np.full(SLOTS, len(top), np.int64)
            look[top] = np.arange(len(top))
            self.classes.append(c / max(c.sum(), 1))
            self.lookup.append(look)
            self.words.append(np.append(w[top], w.sum() - w[top].sum()) / max(w.sum(), 1))


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_words: int = 50, common: int = 64) -> References:
    """The languages' histograms, counted over all documents. The driver gets a bounded row of counts per language."""
    cols = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = cols.mapInArrow(_gather(min_words), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    return References(rows, common)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, the root of the divergence) of each row of p from q."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(p: Profile, ref: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of classes and of common words from the language with the least sum; its index (-1: no reference)."""
    n = p.n
    best, classes, words, lang = np.full(n, np.inf), np.zeros(n), np.zeros(n), np.full(n, -1)
    own = p.classes / np.maximum(p.classes.sum(axis=1), 1)[:, None]
    slots = _slots(p)
    for k in range(len(ref.langs)):
        bins = len(ref.words[k])
        hist = np.bincount(p.word_doc * bins + ref.lookup[k][slots], minlength=n * bins).reshape(n, bins)
        a = divergence(own, ref.classes[k])
        b = divergence(hist / np.maximum(p.n_words, 1)[:, None], ref.words[k])
        nearer = a + b < best
        best, classes, words, lang = np.where(nearer, a + b, best), np.where(nearer, a, classes), np.where(nearer, b, words), np.where(nearer, k, lang)
    return classes, words, lang


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, nearest_lang string, kept boolean"


def _judge(ref: References, min_words: int, class_limit: float, word_limit: float, word_noise: float):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                p = Profile(data, offs)
                failed = base_failed(p)
                classes, words, lang = distances(p, ref)
                far = (p.n_words >= min_words) & (lang >= 0) & ((classes > class_limit) | (words > word_limit + word_noise / np.sqrt(np.maximum(p.n_words, 1))))
                near = pa.array([ref.langs[k] if k >= 0 else None for k in lang], pa.string())
                cols = [p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(classes), pa.array(words), near, pa.array(~failed & ~far)], [x.split()[0] for x in OUT.split(", ")])

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, common: int = 64, class_limit: float = 0.30, word_limit: float = 0.22, word_noise: float = 2.0) -> DataFrame:
    """One row per input row with its counts, distances and verdict.

    A null text is an empty one: no words, base_failed. Rows without a language add nothing to the
    references but are judged by all. Without any reference (no document passes) only the base rules
    decide. Repeated rows are judged one by one; an empty table gives an empty result; other columns
    are not read.
    """
    ref = references(docs, lang_col, text_col, min_words, common)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(_judge(ref, min_words, class_limit, word_limit, word_noise), OUT)


