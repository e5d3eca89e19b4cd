"""Byte-level BPE ids of whole texts, many texts at a time.

Pre-tokenisation (the usual byte-level pattern: contractions, letters, digits, other marks, each with
one leading blank, and white space) is done on arrays of code points. Equal pieces of a batch are
encoded once, and a bounded cache keeps them between batches. Texts with code points whose class could
differ between Unicode versions, or with a special token's string, go to the tokenizer itself.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

from .common import span_hashes

_OTHER, _LETTER, _DIGIT, _BLANK = 0, 1, 2, 3
#: Code points below this, and general punctuation, have had the same class in all Unicode versions of use.
_PLAIN = 0x250
_PUNCTUATION = (0x2000, 0x2070)


def _class(cp: int) -> int:
    c = chr(cp)
    kind = unicodedata.category(c)
    if kind[0] == "L":
        return _LETTER
    if kind[0] == "N":
        return _DIGIT
    return _BLANK if kind[0] == "Z" or c in "\t\n\v\f\r\x85" else _OTHER


def _classes() -> np.ndarray:
    out = np.full(_PUNCTUATION[1], 255, np.uint8)
    for cp in [*range(_PLAIN), *range(*_PUNCTUATION)]:
        out[cp] = _class(cp)
    return out


class Encoder:
    """encode(bytes, offsets) -> (ids, where each text's ids begin)."""

    def __init__(self, tokenizer_json: str, ranks_file: str, cache: int = 1 << 19):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_json)
        self.special = [t.content.encode() for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Only single pieces reach it, so its pattern takes all it gets as one piece.
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = _classes()
        self.limit, self.cache = cache, {}

    def _begins(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of all pieces; which texts must go to the tokenizer itself."""
        first = np.flatnonzero((data & 0xC0) != 0x80)
        cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        top = len(self.classes)
        cls = self.classes[np.minimum(cps, top - 1)]
        cls[cps >= top] = 255
        odd = cls == 255
        n = len(cps)
        at = np.searchsorted(first, offs)  # texts by code point
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        begin = cut[:-1].copy()
        begin[1:] |= cls[1:] != cls[:-1]
        # The last white space of a run before something else: a blank joins what follows, any other stands alone.
        blank = cls == _BLANK
        last = np.flatnonzero(blank[:-1] & begin[1:] & ~cut[1:-1]) if n > 1 else np.zeros(0, np.int64)
        begin[last] = True
        joins = last[cps[last] == 0x20]
        begin[joins + 1] = False
        # Contractions: an apostrophe that begins a piece and is followed by one of the endings.
        tick = np.flatnonzero((cps[:-1] == 0x27) & begin[:-1] & (cls[1:] == _LETTER) & ~cut[1:-1]) if n > 1 else last
        if len(tick):
            a, b = cps[tick + 1], np.where(tick + 2 < n, cps[np.minimum(tick + 2, n - 1)], 0)
            same = ~cut[np.minimum(tick + 2, n)]
            one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
            two = same & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for found, size in ((one, 1), (two & ~one, 2)):
                t = tick[found]
                begin[t + 1] = False
                rest = t + 1 + size
                rest = rest[rest < n]
                begin[rest] |= cls[rest] == _LETTER
        wrong = np.zeros(len(offs) - 1, bool)
        if odd.any():
            wrong[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
        return first[begin], wrong

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        raw = data.tobytes()
        starts, wrong = self._begins(data, offs)
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                wrong[np.searchsorted(offs, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offs, starts, "right") - 1
        if wrong.any():
            fine = ~wrong[doc]
            starts, ends, doc = starts[fine], ends[fine], doc[fine]
        _, where, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        cache, merge = self.cache, self.merge
        if len(cache) > self.limit:
            cache.clear()
        parts = []
        for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True):
            piece = raw[s:e]
            ids = cache.get(piece)
            if ids is None:
                ids = cache[piece] = np.array(merge(piece), np.uint32).tobytes()
            parts.append(ids)
        sizes = np.array([len(p) for p in parts], np.int64) >> 2
        flat = np.frombuffer(b"".join(parts), np.uint32)
        base = np.cumsum(sizes) - sizes
        size = sizes[which]
        total = np.cumsum(size)
        # ids of piece i: flat[base[which[i]] ...], laid end to end
        ids = flat[np.arange(total[-1] if len(total) else 0) + np.repeat(base[which] - (total - size), size)]
        per_doc = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(per_doc)))
        if not wrong.any():
            return ids, bounds
        texts = [raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(wrong)]
        slow = dict(zip(np.flatnonzero(wrong).tolist(), (np.array(e.ids, np.uint32) for e in self.exact.encode_batch(texts, add_special_tokens=False)), strict=True))
        rows = [slow[i] if i in slow else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
