"""Encoding of single words with a tokenizer whose words never cross white space.

The tokenizer replaces white space by a space and drops it when it splits, so a text's ids are those of its
blank-separated words in order. Words are looked up before they are encoded.
"""

from __future__ import annotations

import unicodedata
from functools import cached_property

import numpy as np
from tokenizers import Tokenizer

#: ASCII marks that the tokenizer splits from a word that ends in a letter.
TAIL = b".,;:!?#$%&*"
#: Letters below this code point are looked up in the byte-level table.
LATIN = 0x250


class WordEncoder(dict):
    """Maps a word (UTF-8) to its ids as little-endian bytes of ``self.dtype``; forgets all at ``limit`` words."""

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(LATIN) if chr(c).isalpha() and chr(c) == chr(c).lower()]
        shown = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in letters}
        self.table = {ord(c): x[0][0] for c, x in shown.items() if len(x) == 1}
        self.simple = frozenset(map(chr, self.table))
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _whole(self, word: bytes) -> bytes:
        return self._pack(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(TAIL)
        text = core.decode("utf-8", "replace")
        if core and self.simple.issuperset(text) and unicodedata.is_normalized("NFC", text):
            tail = word[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._whole(tail)
            ids = self._pack([t.id for t in self.model.tokenize(text.translate(self.table))]) + self.tails[tail]
        else:
            ids = self._whole(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def words(self, text: str) -> list[bytes]:
        """The words of a text; A-Z are lower-cased, as the tokenizer does, unless a special token may be meant."""
        raw = text.encode("utf-8", "replace")
        return (raw if b"|>" in raw else raw.lower()).split()

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.words(text))), dtype=self.dtype)

    @cached_property
    def pieces(self) -> list[bytes]:
        """The piece of every id."""
        return [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.size)]

    @cached_property
    def decimal(self) -> list[bytes]:
        """Every id in decimal."""
        return [b"%d" % i for i in range(self.size)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
