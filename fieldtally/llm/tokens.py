"""Byte-level BPE ids of whole texts, by the tokenizers library, each distinct word encoded once.

The vocabulary's pattern never joins a blank to the word before it, so a text can be cut in front of
every single space and around every line feed, and the ids of the pieces put together are the ids of
the text. Texts with other blanks, or blanks next to each other, or at an end, or with a marker of a
special token, are given to the library whole. A word of letters is one run of the pattern, so the
library's merge model takes it directly, and ASCII punctuation behind it is another run, so the word is
merged once for all its endings; other pieces go through the library's whole encoder.
"""

from __future__ import annotations

import os
from itertools import chain, repeat
from string import punctuation as PUNCTUATION

import numpy as np

LINE_FEED = 198
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of batches of texts. The cache of words has a fixed bound and only saves time."""

    def __init__(self, path: str, most_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        vocabulary = self.tokenizer.get_vocab()
        ends, opens = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            ends[i], opens[i] = token[-1] in ".!?", token[0] in "ĠĊ"
        self.sentence_end, self.starts_with_blank = ends, opens
        self.merges = self.tokenizer.model.tokenize
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}  # numbered as they come
        self.starts, self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the half used most, without pieces used once."""
        kept = np.argsort(-self.uses, kind="stable")[:self.most_words // 2]
        kept = np.sort(kept[self.uses[kept] > 1])
        ids, sizes, uses, names = self._joined(kept)[0], self.sizes[kept], self.uses[kept] // 2, list(self.rows)
        self._reset()
        self._add([names[k] for k in kept.tolist()], ids, sizes)
        self.uses += uses

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _plain(text: str) -> bool:
        """Only single spaces and line feeds, none at an end, and no marker of a special token."""
        return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                    or "<|" in text) and text.replace("\n", "").isprintable()

    def _merged(self, stem: str, blank: bool) -> list[int]:
        """Ids of letters only, with or without a space before them: one run of the pattern."""
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.merges("Ġ" + stem if blank else stem)]

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.starts = np.concatenate([self.starts, ends - sizes + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])
        self.flat = np.concatenate([self.flat, ids])
        first = len(self.rows)
        self.rows.update(zip(pieces, range(first, first + len(pieces))))

    def _learn(self, pieces: list[str]) -> None:
        # "w" stands for a space and w, "\nw" for a line feed and w, "\0w" for w at the start of a text.
        # Letters and the punctuation behind them are two runs: "w," is "w" and then "\0,".
        ended, stems, tails, own = [], [], [], {}
        for p in pieces:
            stem = p.rstrip(PUNCTUATION)
            if len(stem) < len(p) and (stem.isalpha() or stem[1:].isalpha() and stem[0] in "\n\0"):
                ended.append(p)
                stems.append(stem)
                tails.append(f"\0{p[len(stem):]}")
            else:
                own[p] = None
        own |= dict.fromkeys(p for p in (*stems, *tails) if p not in self.rows)
        flat: list[int] = []
        ends: list[int] = []
        merged, whole = self._merged, self._ids
        for p in own:
            if p.isalpha():
                flat += merged(p, True)
            else:
                mark = p[:1]
                word = p[1:] if mark in ("\n", "\0") else p
                if mark == "\n":
                    flat.append(LINE_FEED)
                if word.isalpha():
                    flat += merged(word, False)
                elif word:
                    flat += whole(word if mark in ("\n", "\0") else f" {word}")
            ends.append(len(flat))
        self._add(list(own), np.array(flat, np.uint32), np.diff(np.array(ends, np.int64), prepend=0))
        if ended:
            pairs = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(zip(stems, tails))), np.int64, 2 * len(ended))
            self._add(ended, self._joined(pairs)[0], self.sizes[pairs].reshape(-1, 2).sum(1))

    def _joined(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after another, and where each row's end."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if len(self.rows) > self.most_words:
            self._forget()
        pieces: list[str] = []
        counts, whole = [], {}
        for k, text in enumerate(texts):
            if text and self._plain(text):
                own = text.replace("\n", " \n").split(" ")
                own[0] = f"\0{own[0]}"
                pieces += own
                counts.append(len(own))
            else:
                whole[k] = self._ids(text) if text else []
                counts.append(0)
        rows = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            self._learn(list({pieces[k] for k in missing}))
            rows[missing] = [self.rows[pieces[k]] for k in missing]
        self.uses += np.bincount(rows, minlength=len(self.uses))
        ids, ends = self._joined(rows)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        lengths = np.diff(bounds)
        if any(whole.values()):
            parts = np.split(ids, bounds[1:-1])
            for k, own in whole.items():
                parts[k] = np.array(own, np.uint32)
            ids, lengths = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, lengths


def encoder(path: str) -> Encoder:
    """One encoder in each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_with_end(path: str, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``Encoder.encode``, with ``end_id`` after each text."""
    ids, lengths = encoder(path).encode(texts)
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1
