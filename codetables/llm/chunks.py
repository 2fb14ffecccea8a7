"""Encoding whole texts with the public tokenizers library, each distinct piece of text once.

A text is cut where no pre-token of either vocabulary can cross: between what is not white space and white
space, and between letters and simple punctuation.  So the ids of a text are the ids of its pieces in order.
White space other than space, tab and line ends joins runs that such a cut would split; a text that holds
any is passed to the library whole (where the vocabulary keeps white space), as is one that holds an added token
such as <|endoftext|>, which the library gives its own id.  Pieces that are one pre-token of plain letters go straight to the
library's BPE model, which spares its normalisation and offsets.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np

from codetables.llm.common import quiet_tokenizers

_L, _P = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?#$%&*"
_SIMPLE = rf"[{_L}]+(?=[ \n\t\r{_P}]|$)"
#: Pieces for a vocabulary that drops white space, and for one that keeps it.
WORDS = re.compile(rf"{_SIMPLE}|[{_P}]+(?=[ \n\t\r]|$)|[^ \n\t\r]+")
PIECES = re.compile(rf"\n(?=[^ \n\t\r])|[ \n\t\r]*{_SIMPLE}|[{_P}]+(?=[ \n\t\r]|$)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
PLAIN = re.compile(rf" ?[{_L}]+")
#: Separators that Unicode or a regex library counts as white space, besides the four above.
ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
#: Characters whose small letter depends on more than themselves, or that may combine with their neighbours, are among these.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Pieces that a worker remembers at least, and at most twice: about 120 MB.
CACHE = 300_000


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    """ids of texts as little-endian 16-bit or 32-bit bytes, by the library."""

    def __init__(self, path: str, drops_space: bool, cache: int = CACHE):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = (WORDS if drops_space else PIECES).findall
        self.drops_space, self.limit, self.letters = drops_space, cache, byte_letters()
        self.recent, self.before = {}, {}
        tried = ["Word", "Größe", "ÀÉÎ"] if drops_space else ["Word", " Größe", " ÀÉÎ", " a"]
        self.direct = [self._model(x) for x in tried] == self._library(tried)  # else this vocabulary is of another kind

    def _model(self, piece: str) -> bytes:
        """ids of a piece that is one pre-token of plain letters."""
        if self.drops_space:
            piece = piece.lower()
        marked = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(marked)], dtype=self.dtype).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in out]

    def _learn(self, pieces: set[str]) -> None:
        tokenize, kind, typecode = self.tokenizer.model.tokenize, self.letters, "H" if self.dtype.itemsize == 2 else "I"
        others = []
        for x in pieces:
            if not self.direct or not PLAIN.fullmatch(x):
                others.append(x)
                continue
            y = x.lower() if self.drops_space else x
            y = y.replace(" ", kind[32]) if y.isascii() else y.encode("utf-8").decode("latin-1").translate(kind)
            self.recent[x] = array(typecode, [t.id for t in tokenize(y)]).tobytes()
        if others:
            self.recent.update(zip(others, self._library(others), strict=True))

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None for one that the library must see whole."""
        if self.drops_space:
            text = text if BEYOND.search(text) else text.lower()
        elif ODD_SPACE.search(text):
            return None
        return None if any(x in text for x in self.added) else self.pieces(text)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return self.encode_cut(texts, [self._cut(t) for t in texts])

    def encode_cut(self, texts: Iterable[str], cut: list[list[str] | None]) -> list[bytes]:
        """``encode`` with the pieces of each text, or None for a text to be encoded whole."""
        if len(self.recent) > self.limit:  # what is asked for again comes back from ``before``
            self.before, self.recent = self.recent, {}
        recent, before = self.recent, self.before
        new = set().union(*(c for c in cut if c is not None)).difference(recent)
        known = [x for x in new if x in before]  # set.intersection would run over all of ``before``
        recent.update(zip(known, map(before.__getitem__, known), strict=True))
        self._learn(new.difference(known))
        get = recent.__getitem__
        return [self._library([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, drops_space: bool) -> ChunkEncoder:
    """One encoder per Python worker; its cache lives as long as the worker."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = ChunkEncoder(path, drops_space)
    return _ENCODERS[path, drops_space]


def groups(items: list, weight, most: int) -> Iterable[list]:
    """Runs of items of at most ``most`` total weight (one item at least)."""
    run, total = [], 0
    for x in items:
        w = weight(x)
        if run and total + w > most:
            yield run
            run, total = [], 0
        run.append(x)
        total += w
    if run:
        yield run
