"""Token ids of whole texts by a lower-casing word BPE, word by word."""

from __future__ import annotations

import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
from tokenizers import Tokenizer  # noqa: E402

from .common import CACHES  # noqa: E402

#: Words whose ids one worker keeps; a word beyond them is encoded each time it comes.
CACHE = 600_000
#: str.split() cuts at these too, the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")
#: Outside these, lower-casing before the normaliser might differ from lower-casing in it.
PLAIN = re.compile("[^\x00-\u024f\u2010-\u2027]")


class WordTokens:
    """Ids as the tokenizer gives them, without special tokens added.

    The tokenizer's words never span white space and its normaliser never looks past
    a word, so each distinct word is encoded once and its ids kept (as little-endian
    unsigned 32-bit bytes).  Special tokens that stand in a text are found as the
    tokenizer finds them: they hold no white space either.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.tails = dict(zip(".,", self.encode_raw([".", ","]), strict=True))

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [struct.pack(f"<{len(i)}I", *i) for i in ids]

    def ids_bytes(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if ODD.search(text):
            return self.encode_raw([text])[0]
        plain = (text.isascii() or not PLAIN.search(text)) and "<|" not in text
        if plain:
            text = text.lower()
        words = text.split()
        parts = list(map(self.known.get, words))
        if None in parts:
            found = self.encode_words({w for w, p in zip(words, parts, strict=True) if p is None}, plain)
            parts = [found[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)

    def encode_words(self, new: set[str], plain: bool) -> dict[str, bytes]:
        """The ids of words that are not known yet; they are kept while there is room.

        In a plain text, letters and a full stop or comma behind them are two runs for the
        tokenizer, whatever they are: the letters are encoded once for all three forms.
        """
        known, tails = self.known, self.tails
        stems = {w: w[:-1] for w in new if w[-1] in tails and w[:-1].isalpha()} if plain else {}
        rest = [w for w in new if w not in stems]
        rest += {x for x in stems.values() if x not in known and x not in new}
        found = dict(zip(rest, self.encode_raw(rest), strict=True))
        for w, stem in stems.items():
            found[w] = (found[stem] if stem in found else known[stem]) + tails[w[-1]]
        if len(known) + len(found) <= CACHE:
            known.update(found)
        return found


_TOKENS: dict[str, WordTokens] = {}
CACHES["words"] = lambda: [t.known.clear() for t in _TOKENS.values()]


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker and file."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]
