"""Whole-text encoding with the tokenizers library, with ids remembered by word.

``word_bpe_49k.json`` drops white space and never merges across it, and its special tokens hold
none, so the ids of a text are those of its ASCII-white-space separated words, one after the
other. As the library does by itself, a special token's string in a text gets that token's id. Each
distinct word goes through the library once; two generations of a bounded dictionary
keep the frequent ones.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Letters that stay single letters under NFC and lower-casing, so that a run of them is one pre-token.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ſ]+")
#: Signs that always form a pre-token apart from the letters before them (no apostrophe, which does not).
_TAIL = '.,;:!?*#$%&|<>()[]{}"/-_=+~^@'
_SPLIT = re.compile("[\x20\x09-\x0d]+")
#: str.split() also cuts at these, which the word rule does not name; texts that hold them take _SPLIT.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """``ids(text)``: the text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keep: int = 350_000):
        self.t = load_tokenizer(path)
        self.keep = keep
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(words, add_special_tokens=False)]

    def _runs(self, words: list[str]) -> list[bytes]:
        """Ids of words of _LETTERS, joined by spaces: each ends at its one token with the word-end mark."""
        out: list[bytes] = []
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            ids = np.array(self.t.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), (ends * 4).tolist()
                out += [raw[a:b] for a, b in zip([0, *at], at)]
            else:
                out += self._whole(part)
        return out

    def _learn(self, words) -> None:
        known, old, cores, rest = self.new, self.old, {}, []
        for w in words:
            if (x := old.get(w)) is not None:
                known[w] = x
                continue
            core = w.rstrip(_TAIL)
            if core and _LETTERS.fullmatch(core):
                low = core.lower()
                cores.setdefault(low, []).append((w, w[len(core) :]))
            else:
                rest.append(w)
        todo = []
        for low in cores:
            if low not in known:
                if (x := old.get(low)) is not None:
                    known[low] = x
                else:
                    todo.append(low)
        for w, x in zip(todo, self._runs(todo)):
            known[w] = x
        tails = sorted({t for v in cores.values() for _, t in v if t and t not in known})
        for w, x in zip(tails, self._whole(tails)):
            known[w] = x
        for low, v in cores.items():
            for w, tail in v:
                known[w] = known[low] + known[tail] if tail else known[low]
        for w, x in zip(rest, self._whole(rest)):
            known[w] = x

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        odd = _ODD[:4] if text.isascii() else _ODD
        words = [w for w in _SPLIT.split(text) if w] if any(c in text for c in odd) else text.split()
        new = self.new
        try:
            return b"".join(map(new.__getitem__, words))
        except KeyError:
            pass
        if len(new) > self.keep:
            self.old, self.new = new, {}
            new = self.new
        self._learn([w for w in set(words) if w not in new])
        return b"".join(map(new.__getitem__, words))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
