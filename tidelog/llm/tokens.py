"""Token ids of whole texts by the public word-level BPE, with a cache of words."""

from __future__ import annotations

import re
import sys
import types
import unicodedata
from array import array

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids are kept; a full cache starts anew, so that memory does not follow the vocabulary of the corpus.
CACHE = 150_000
#: Encoders live in a module of their own in each process, since functions sent to workers get new globals each time.
_HOME = "tidelog_encoders"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c)).startswith(kind))


class WordEncoder(dict):
    """word -> its ids as unsigned 32-bit bytes, little-endian as all machines that Spark runs on; encode() does whole texts.

    The tokenizer lower-cases, parts a text into words by a pattern and encodes each word for itself, so that equal
    words have equal ids. Texts of printable Latin characters, white space and nothing that normalisation would
    compose are parted here, and only words new to the cache go to the library; all other texts go to it whole.
    With `specials`, strings of special tokens in a text become their ids, as by the library's plain call; without,
    they are ordinary text.
    """

    def __init__(self, vocabulary: str, specials: bool):
        super().__init__()
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not specials
        self.model = self.whole.model
        self.marks = tuple(t.content for t in self.whole.get_added_tokens_decoder().values()) if specials else ()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.printable = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        letter, digit = _class("L"), _class("N")
        # Fixed value: the pattern by which this vocabulary parts words.
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+").findall
        self.odd = re.compile("[^\t\n\x0b\x0c\r -~\xa0-\u012f\u0131-\u017f]").search

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.by_model(word)
        return ids

    def by_model(self, word: str) -> bytes:
        """The ids of one lower-case word; the model reads bytes as printable characters, which those of ASCII are."""
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.printable)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def by_library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.odd(text) or any(m in text for m in self.marks):
            return self.by_library(text)
        return b"".join(map(self.__getitem__, self.words(text.lower())))


def forget() -> None:
    """Empties the caches of this process's encoders, as its next task may need the memory for something else."""
    for e in sys.modules.get(_HOME, types.ModuleType(_HOME)).__dict__.values():
        if isinstance(e, dict) and hasattr(e, "by_model"):
            e.clear()


def encoder(vocabulary: str = VOCABULARY, specials: bool = True) -> WordEncoder:
    """This process's encoder for a vocabulary."""
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
    if (vocabulary, specials) not in home:
        home[vocabulary, specials] = WordEncoder(vocabulary, specials)
    return home[vocabulary, specials]
