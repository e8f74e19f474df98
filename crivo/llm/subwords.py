"""Subword ids of whole texts through a public tokenizer file, word by word with a cache."""

from __future__ import annotations

import os
import re
from struct import pack
from unicodedata import normalize

_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the tokenizer
#: Bits of the hashes by which words met once are noted: one byte for each hash.
MET_BITS = 20
MAX_WORDS = 300_000
_STOPS = frozenset(".,;:!?")
_CODERS: dict[tuple[str, int], Coder] = {}


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, others from 256 up."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(others)}


class _Words(dict):
    """Ids of words, as little-endian unsigned 32-bit numbers; a word is encoded when asked for and kept from the second time on.

    Most words of a corpus are rare, so `met` notes which were asked for once, by a hash: a word that shares it with another
    is only kept early. Half of `max_words` fill this table. It then becomes `older` and is filled anew, with words of `older`
    taken over as they are met again: frequent words stay, and no more than `max_words` are held.
    """

    def __init__(self, tokenizer, max_words: int):
        self.tokenizer, self.model, self.max_words = tokenizer, tokenizer.model, max_words
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}
        self.met = bytearray(1 << MET_BITS)

    def __missing__(self, word: str) -> bytes:
        coded = self.older.get(word)
        if coded is None:
            coded, at = self.code(word), hash(word) & (1 << MET_BITS) - 1
            if not self.met[at] or len(word) > 100:
                self.met[at] = 1
                return coded
        if len(self) >= self.max_words // 2:
            self.older = dict(self)
            self.clear()
            self.met = bytearray(1 << MET_BITS)
        self[word] = coded
        return coded

    def code(self, word: str) -> bytes:
        lower = word if word.isascii() else normalize("NFC", word).replace("Σ", "σ").lower()  # letter by letter, as the tokenizer does
        if lower.isalpha():  # one piece to the tokenizer's splitter: straight to its merges
            if not lower.isascii():
                lower = lower.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(lower)]
            return pack(f"<{len(ids)}I", *ids)
        if word[-1] in _STOPS and lower[:-1].isalpha():  # splits before the stop
            return (self.get(word[:-1]) or self.code(word[:-1])) + self[word[-1]]
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)


class Coder:
    """Encodes with a `tokenizers` file of byte-level BPE with lower-casing, whose words never span white space.

    A text's ids are then the ids of its white-space-separated words in order. Words repeat, so their ids are kept:
    at most those of `max_words` of them. Words over 100 characters are not kept.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(self.tokenizer, max_words)

    def whole(self, text: str) -> bytes:
        """The text's ids straight from the tokenizer, as little-endian unsigned 32-bit numbers."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The same ids as `whole` gives, through the cache; a null text is empty."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self.whole(text)
        lower = text.lower() if text.isascii() else text.encode().lower().decode()
        return b"".join(map(self.known.__getitem__, lower.split()))


def coder(path: str, max_words: int = MAX_WORDS) -> Coder:
    """The worker's coder for a tokenizer file: tasks that follow each other in one worker share its cache."""
    key = (path, max_words)
    if key not in _CODERS:
        _CODERS[key] = Coder(path, max_words)
    return _CODERS[key]
