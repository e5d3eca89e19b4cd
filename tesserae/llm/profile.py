"""Counts of a text that the quality operators share, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import LOWER, mix64, span_hashes, windows, word_spans

#: The classes of single bytes. Bytes of characters beyond ASCII are one class each for lead and rest.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "quote", "bracket", "exclaim", "pipe", "symbol", "mark", "lead", "rest", "control")
_MEMBERS = {"blank": " \t", "line": "\n\r\v\f", "stop": ".,;:?", "quote": "'\"`-", "bracket": "()[]{}", "exclaim": "!", "pipe": "|", "symbol": "#*$%&<>@^~=+\\/_"}
CLASS_OF = np.full(256, CLASSES.index("control"), np.uint8)
CLASS_OF[0x21:0x7F] = CLASSES.index("mark")
CLASS_OF[ord("a") : ord("z") + 1] = CLASSES.index("lower")
CLASS_OF[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
CLASS_OF[ord("0") : ord("9") + 1] = CLASSES.index("digit")
CLASS_OF[0x80:0xC0] = CLASSES.index("rest")
CLASS_OF[0xC0:] = CLASSES.index("lead")
for _name, _chars in _MEMBERS.items():
    for _c in _chars:
        CLASS_OF[ord(_c)] = CLASSES.index(_name)

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Profile:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, classes.

    word_doc and word_hash (lower-cased A-Z) are there for further counts by word.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int = 8):
        n = self.n = len(offs) - 1
        starts, ends, first = word_spans(data, offs)
        self.n_words = np.diff(first)
        doc = self.word_doc = np.repeat(np.arange(n), self.n_words)
        lead = (data & 0xC0) != 0x80
        self.n_chars = _between(lead, offs)
        word_bytes = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=word_bytes[1:])
        self.word_chars = np.bincount(doc, weights=word_bytes[ends] - word_bytes[starts], minlength=n).astype(np.int64)
        self.n_symbols = _between(SYMBOL[data], offs)
        place = np.repeat(np.arange(n) * len(CLASSES), np.diff(offs)) + CLASS_OF[data]
        self.classes = np.bincount(place, minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
        self._lines(data, offs, starts)
        exact = span_hashes(data, starts, ends)
        self._repeats(exact, doc, window)
        self.word_hash = span_hashes(LOWER[data], starts, ends)
        self.n_distinct = self._distinct(doc)

    def _distinct(self, doc: np.ndarray) -> np.ndarray:
        key = np.sort((self.word_hash >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40)))
        if not len(key):
            return np.zeros(self.n, np.int64)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=self.n)

    def _lines(self, data: np.ndarray, offs: np.ndarray, word_starts: np.ndarray) -> None:
        feeds = np.flatnonzero(data == 0x0A)
        begin = np.union1d(offs[:-1][np.diff(offs) > 0], feeds + 1)
        begin = begin[begin < len(data)]
        end = np.append(begin[1:], len(data))
        stop = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 0x0A)) if len(begin) else end
        worded = np.searchsorted(word_starts, begin) < np.searchsorted(word_starts, stop)
        begin, stop = begin[worded], stop[worded]
        doc = np.searchsorted(offs, begin, "right") - 1
        self.n_lines = np.bincount(doc, minlength=self.n)
        _, where = np.unique(mix64(span_hashes(data, begin, stop) + doc.astype(np.uint64)), return_index=True)
        self.n_dup_lines = self.n_lines - np.bincount(doc[where], minlength=self.n)

    def _repeats(self, h: np.ndarray, doc: np.ndarray, k: int) -> None:
        self.n_repeat_words = np.zeros(self.n, np.int64)
        w = windows(h, k)
        if not len(w):
            return
        at = np.flatnonzero(doc[: len(w)] == doc[k - 1 :])
        key = mix64(w[at] + doc[at].astype(np.uint64))
        s = np.sort(key)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            return
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = at[twice[place] == key]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + k, -1)
        self.n_repeat_words = np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=self.n).astype(np.int64)


def _between(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]
