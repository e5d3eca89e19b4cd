"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier (multinomial naive
Bayes over byte-class trigrams, so a linear one) tells the languages whose bit is 1 from the others.
Decoding sums, over the bits, the logistic loss of each codeword at the classifiers' margins, every bit
weighted by how well it separates its training languages, and takes the codeword of least loss.

Training needs only trigram counts by language, which are summed over all training documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod

SYMBOLS = 32
SLOTS = SYMBOLS**3
#: Classes of bytes: letters by themselves without case, other ASCII in one, bytes beyond ASCII in five.
BYTE_CLASS = np.zeros(256, np.int64)
for _i in range(26):
    BYTE_CLASS[ord("a") + _i] = BYTE_CLASS[ord("A") + _i] = 1 + _i
BYTE_CLASS[0x80:] = 27 + (np.arange(0x80, 0x100) * 7 // 4) % 5
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(data: np.ndarray) -> np.ndarray:
    """The slot of the trigram that begins at each byte (two fewer than bytes)."""
    c = BYTE_CLASS[data]
    return c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def each_text(data: np.ndarray, offs: np.ndarray):
    slots = trigrams(data)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        got = slots[a : max(a, b - 2)]
        yield got[got != 0]  # a trigram without any letter tells nothing


def _gather(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, hi, data, offs in chunks(b.column(1)):
            by: dict[str, list[np.ndarray]] = {}
            for lang, slots in zip(langs[lo:hi], each_text(data, offs), strict=True):
                by.setdefault(lang, []).append(slots)
            for lang, parts in by.items():
                counts = total.setdefault(lang, np.zeros(SLOTS + 1, np.int64))
                counts[:SLOTS] += np.bincount(np.concatenate(parts), minlength=SLOTS)
                counts[SLOTS] += len(parts)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "slot", "n"])


def codewords(n: int, bits: int, seed: int = 11) -> np.ndarray:
    """n codewords: all different bit splits if there are few, else random ones that lie far apart."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if 2 ** (n - 1) - 1 <= bits:
        splits = np.arange(1, 2 ** (n - 1))
        return ((splits[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, bits)).astype(np.int8)
        code[0, code.min(axis=0) == code.max(axis=0)] ^= 1  # each bit splits the languages
        near = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if near > apart:
            best, apart = code, near
    return best


class Codes:
    """The trained bits: weights (slots x bits), offsets, and what decoding needs."""

    def __init__(self, counts: dict[str, np.ndarray], bits: int = 31, smooth: float = 0.5):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs), bits)
        n = self.code.shape[1]
        share = {k: (c[:SLOTS] + smooth) / (c[:SLOTS].sum() + smooth * SLOTS) for k, c in counts.items()}
        self.weights = np.zeros((SLOTS, n), np.float64)
        for j in range(n):
            # Languages weigh alike within a side, whatever they have in the corpus.
            one = np.mean([share[k] for i, k in enumerate(self.langs) if self.code[i, j]], axis=0)
            zero = np.mean([share[k] for i, k in enumerate(self.langs) if not self.code[i, j]], axis=0)
            self.weights[:, j] = np.log(one / zero)
        means = np.array([share[k] @ self.weights for k in self.langs]) if n else np.zeros((len(self.langs), 0))
        signs = 2.0 * self.code - 1
        self.scale = np.abs(means).mean(axis=0) + 1e-9 if n else np.zeros(0)
        gap = (means * signs).min(axis=0) if n else np.zeros(0)
        self.bit_weight = np.clip(gap / self.scale, 0.05, None) if n else np.zeros(0)
        self.signs = signs

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and ambiguity for rows of mean log ratios per bit."""
        rows = len(margin)
        if len(self.langs) == 1:
            return np.zeros(rows, np.int64), np.ones(rows), np.zeros(rows, bool)
        z = 4 * margin / self.scale
        loss = (np.logaddexp(0, -z[:, None, :] * self.signs[None]) * self.bit_weight).sum(axis=2)
        p = np.exp(loss.min(axis=1)[:, None] - loss)
        p /= p.sum(axis=1)[:, None]
        first = p.argmax(axis=1)
        score = p[np.arange(rows), first]
        second = np.sort(p, axis=1)[:, -2]
        return first, score, score < 2 * second


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 4, remainder: int = 2, bits: int = 31) -> Codes | None:
    """Learns from all documents with a language whose crc32(id) mod ``held_out`` is not ``remainder``."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(F.col(id_col).cast("long"), held_out) != remainder))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(_gather, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()  # at most SLOTS + 1 rows a language
    counts: dict[str, np.ndarray] = {}
    for lang, slot, n in sums:
        counts.setdefault(lang, np.zeros(SLOTS + 1))[slot] = n
    return Codes(counts, bits) if counts else None


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw.decode("utf-8", "replace")))


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def _predict(codes: Codes | None):
    names = codes.langs if codes else []

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                n = hi - lo
                seen = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_ASCII_LETTER[data], out=seen[1:])
                letter = seen[offs[1:]] > seen[offs[:-1]]
                for i in np.flatnonzero(~letter & (np.diff(offs) > 0)):
                    letter[i] = has_letter(data[offs[i] : offs[i + 1]].tobytes())
                if codes is None:
                    lang, score, unsure = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
                    letter[:] = False
                else:
                    margin = np.zeros((n, codes.weights.shape[1]))
                    for i, slots in enumerate(each_text(data, offs)):
                        if len(slots):
                            margin[i] = np.bincount(slots, minlength=SLOTS) @ codes.weights / len(slots) if len(slots) > 4000 else codes.weights[slots].mean(axis=0)
                    lang, score, unsure = codes.decode(margin)
                pred = [names[k] if ok else "und" for k, ok in zip(lang, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(pred, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(unsure | ~letter)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 4, remainder: int = 2, bits: int = 31) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous.

    A null text, or one without a letter, is "und" with score 0; so is any text if nothing could be
    learned. A null id is neither held out nor learned from. Ties go to the first language by code
    point. Repeated rows are judged one by one; an empty table gives an empty result.
    """
    codes = train(docs, id_col, text_col, lang_col, held_out, remainder, bits)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = cols.mapInArrow(_predict(codes), "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out) == remainder, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
