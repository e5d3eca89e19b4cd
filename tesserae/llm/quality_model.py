"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: each round gives every feature, in turn, one shallow tree over its bins, fitted to the
log-loss gradient; its leaves are added to the feature's look-up table. The pairs that explain most of
what remains get tables over two features in the same way. A score is the intercept plus one entry of
each table, so scoring a batch is a vectorised addition by bin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, written
from .profile import CLASSES, Profile

_SHARES = ("upper", "digit", "line", "stop", "quote", "bracket", "exclaim", "pipe", "symbol", "mark", "lead", "control")
FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_lines", "repeat_words", "distinct_words", "words_per_line", "blank_share", *(f"{c}_share" for c in _SHARES))


def features(p: Profile) -> np.ndarray:
    """A row of FEATURES per text; an empty text has zeros."""
    words, lines, total = np.maximum(p.n_words, 1), np.maximum(p.n_lines, 1), np.maximum(p.classes.sum(axis=1), 1)
    share = lambda c: p.classes[:, CLASSES.index(c)] / total
    cols = [np.log1p(p.n_words), p.word_chars / words, p.n_symbols / words, p.n_dup_lines / lines, p.n_repeat_words / words, p.n_distinct / words, np.log1p(p.n_words / lines), share("blank"), *(share(c) for c in _SHARES)]
    return np.stack(cols, axis=1)


def _features(batches):
    for b in batches:
        for lo, hi, data, offs in chunks(b.column(1)):
            x = features(Profile(data, offs))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", *FEATURES])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(_features, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


class AdditiveModel:
    """Fitted tables. bins: cut points per feature; tables per feature; pairs: (i, j, table)."""

    def __init__(self, intercept: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.intercept, self.cuts, self.tables, self.pairs = intercept, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        for i, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            f += t[np.searchsorted(cut, x[:, i], "right")]
        for i, j, ci, cj, t in self.pairs:
            f += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """Leaf values per bin of a tree of that depth: the splits with the largest gain in g^2 / (h + smooth)."""
    out = np.full(len(g), g.sum() / (h.sum() + smooth))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + smooth) + (g.sum() - a) ** 2 / (h.sum() - b + smooth)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-9:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1, smooth), _tree(g[k:], h[k:], depth - 1, smooth)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rounds: int = 150, rate: float = 0.1, smooth: float = 2.0) -> AdditiveModel:
    """Fits the tables to labels 0/1. Without rows of both labels the model is a constant."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, i], bins) if n else np.zeros(0) for i in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if not n or y.min() == y.max():
        return AdditiveModel(start, cuts, tables, [])
    at = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    f = np.full(n, start)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-f))), p * (1 - p))
    for _ in range(rounds):
        for i in range(width):
            g, h = slope()
            step = rate * _tree(np.bincount(at[i], g, len(tables[i])), np.bincount(at[i], h, len(tables[i])), 2, smooth)
            tables[i] += step
            f += step[at[i]]
    small = [_cuts(x[:, i], pair_bins) for i in range(width)]
    pat = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(small)]
    g, h = slope()
    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            cell = pat[i] * (len(small[j]) + 1) + pat[j]
            gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + smooth)).sum()), i, j))
    chosen = [(i, j, np.zeros((len(small[i]) + 1, len(small[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 3):
        for i, j, t in chosen:
            g, h = slope()
            cell = pat[i] * t.shape[1] + pat[j]
            a, b = np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape)
            # one split of the first feature, then a tree over the second on either side
            k = int(np.argmax([(_gain(a[:s], b[:s], smooth) + _gain(a[s:], b[s:], smooth)) for s in range(1, len(a))])) + 1 if len(a) > 1 else len(a)
            step = np.empty_like(t)
            step[:k] = _tree(a[:k].sum(axis=0), b[:k].sum(axis=0), 1, smooth)
            if k < len(a):
                step[k:] = _tree(a[k:].sum(axis=0), b[k:].sum(axis=0), 1, smooth)
            t += rate * step
            f += rate * step[pat[i], pat[j]]
    return AdditiveModel(start, cuts, tables, [(i, j, small[i], small[j], t) for i, j, t in chosen])


def _gain(a: np.ndarray, b: np.ndarray, smooth: float) -> float:
    g, h = a.sum(axis=0), b.sum(axis=0)
    return float((g**2 / (h + smooth)).sum())


def _score(model: AdditiveModel):
    def run(batches):
        for b in batches:
            x = np.stack([b.column(1 + i).to_numpy() for i in range(len(FEATURES))], axis=1) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def train(table: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: int = 5, sample: int = 20_000) -> AdditiveModel:
    """Fits on at most ``sample`` labelled rows (by a hash of the id) whose crc32(id) mod ``held_out`` is not 0.

    Null ids and labels are left out; an id labelled more than once counts with its largest label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (crc_mod(F.col("doc_id"), held_out) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("double").alias("_y"))
    rows = known.join(table, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("_y", *FEATURES).toArrow()
    x = np.stack([rows.column(f).to_numpy() for f in FEATURES], axis=1) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, rows.column("_y").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only the text decides a score; a null text is an empty one and has a score too. A null id is not
    held out. Repeated rows are scored one by one, an empty table gives an empty result, and other
    columns are not read.
    """
    table = written(feature_table(docs, id_col, text_col), "quality-features")
    model = train(table, labels, held_out=held_out, sample=sample)
    out = table.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
